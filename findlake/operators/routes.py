"""Routes that code registers, and those that anyone may call. Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: languages, how a route is registered (method, path, the rest of the line); without a method's group it may be any
SHAPES = [
    (("go",), r"\.(?:HandleFunc|Handle)\(\s*\"(?:(GET|POST|PUT|PATCH|DELETE)\s+)?(/[^\"]*)\"\s*,(.*)$"),
    (("go",), r"\b\w+\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*\"(/[^\"]*)\"\s*,(.*)$"),
    (("python",), r"^[ \t]*@\w+\.(get|post|put|patch|delete)\(\s*[rf]?[\"'](/[^\"']*)[\"'](.*)$"),
    (("typescript", "javascript", "java"), r"\b(?:app|router|api|server|routes|r|\w+Router|\w+_router)\.(get|post|put|patch|delete)\(\s*[\"'`](/[^\"'`]*)[\"'`]\s*,?(.*)$"),
    (("java",), r"^[ \t]*@(Get|Post|Put|Patch|Delete)Mapping\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(/[^\"]*)\"(.*)$"),
    (("ruby",), r"^[ \t]*(get|post|put|patch|delete)\s+[\"'](/[^\"']*)[\"'](.*)$"),
]
# fixed values: signs that a repository authenticates someone, that it sends mail, that a route is guarded where it stands
AUTH = (
    r"(?i)\blogin_required\b|\brequire_?(?:auth|login|user|admin|token|session)\w*|\bauthenticate(?:d|s|_\w+)?\b|\bauthori[sz](?:e|ed|es|ation|ing|er)\w*|\bBearer\b|\bjwt\b|\bjsonwebtoken\b|\bpassport\b"
    r"|\bapi[_-]?key\b|x-api-key|\bcurrent_user\b|\bcurrentUser\b|@PreAuthorize|@Secured|@RolesAllowed|SecurityFilterChain|http_basic_authenticate|\bBasicAuth\b|\bbasic_auth\b|\bverify_password\b|\bcheck_password\b"
    r"|\bpassword_hash\b|\bbcrypt\b|\bhmac\b|\bsession\[|\bOAuth|\bis_authenticated\b|\bget_current_user\b|\bHTTPBearer\b"
)
MAIL = r"\bsmtplib\b|\"net/smtp\"|\bnodemailer\b|\bjakarta\.mail\b|\bjavax\.mail\b|\bNet::SMTP\b|\bActionMailer\b|\bdelivery_method\b|\bMail\.new\b|\bsmtp\.SendMail\b|\bsendgrid\b|\bmailgun\b"
GUARD = r"(?i)\b\w*(?:auth|admin|login|jwt|token|permission|role|protect|guard|session|secur|signed|current_?user|deny|acl|polic|verif|user_?id)\w*\b|\brequire\w+"
#: What every match of AUTH or MAIL holds one of, in lower case; finding that is cheaper than matching.
AUTH_WORDS = (
    "auth", "require", "login_required", "bearer", "jwt", "webtoken", "passport", "apikey", "api_key", "api-key", "current_user", "currentuser", "@secured", "@rolesallowed", "securityfilterchain",
    "verify_password", "check_password", "password_hash", "bcrypt", "hmac", "session[",
)
MAIL_WORDS = ("smtp", "nodemailer", "jakarta.mail", "javax.mail", "actionmailer", "delivery_method", "mail.new", "sendgrid", "mailgun")
DESTRUCTIVE = r"(?i)/(?:admin|purge|wipe|flush)(?:/|$|\b)"
INLINE = ("go", "typescript", "javascript", "python")
NEAR = 5


def routes(files: DataFrame) -> DataFrame:
    """repo_id, path, language, line_no, method, route, guarded of every line that registers a route.

    A guard stands on the line behind the path, in the decorators around it, or in what the signature below depends on. Comments
    at a line's end say nothing. A file's lines stay one array; only lines that hold a slash and a quote, as every shape does, are matched,
    and comments are taken off these and the lines around a hit.
    """
    anything = "|".join(f"(?:{shape})" for _, shape in SHAPES)
    bare = lambda line: F.regexp_replace(line, r"\s(?://|#).*$", "")
    may = lambda text: F.contains(text, F.lit("/")) & (F.contains(text, F.lit('"')) | F.contains(text, F.lit("'")) | F.contains(text, F.lit("`")))
    some = files.where(may(F.col("content"))).select("repo_id", "path", "language", F.split("content", "\n").alias("code"))
    spots = F.filter(F.sequence(F.lit(1), F.size("code")), lambda i: may(F.element_at("code", i)) & bare(F.element_at("code", i)).rlike(anything))
    decorators = lambda part: F.array_join(F.filter(part, lambda x: x.rlike(r"^\s*@")), "\n")
    around = F.transform(spots, lambda i: F.struct(i.alias("line_no"), bare(F.element_at("code", i)).alias("line"), F.transform(F.slice("code", F.greatest(i - NEAR, F.lit(1)), i - F.greatest(i - NEAR, F.lit(1))), bare).alias("before"), F.transform(F.slice("code", i + 1, F.lit(NEAR)), bare).alias("after")))
    hits = some.select("repo_id", "path", "language", F.explode(around).alias("h")).select("repo_id", "path", "language", "h.*")
    found = F.coalesce(*[F.when(F.col("language").isin(*languages) & F.col("line").rlike(shape), F.struct(*[F.regexp_extract("line", shape, k).alias(name) for k, name in ((1, "method"), (2, "route"), (3, "rest"))])) for languages, shape in SHAPES])
    hits = hits.withColumn("f", found).where("f is not null")
    decorated = F.concat_ws("\n", decorators(F.col("before")), decorators(F.col("after")), F.array_join(F.regexp_extract_all(F.array_join("after", "\n"), F.lit(r"\b(?:Depends|Security)\(([^()]*)"), 1), "\n"))
    context = F.concat_ws("\n", "f.rest", F.when(F.col("line").rlike(r"^\s*@"), decorated))
    method = F.when(F.col("f.method") == "", "any").otherwise(F.lower("f.method"))
    return hits.select("repo_id", "path", "language", "line_no", method.alias("method"), "f.route", F.replace(context, F.col("f.route"), F.lit("")).rlike(GUARD).alias("guarded"))


def open_routes(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, method, route, issue (destructive or mail) of the routes that anyone may call.

    Destructive: deletes or administers, unguarded, while its repository authenticates nobody or other routes of its file are
    guarded where they stand. Mail: writes, unguarded, in a repository that sends mail and authenticates nobody.
    """
    lower = F.lower("content")
    holds = lambda words: reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in words])
    signs = [(holds(words) & F.col("content").rlike(shape)).alias(name) for words, shape, name in ((AUTH_WORDS, AUTH, "auth"), (MAIL_WORDS, MAIL, "mail"))]
    repos = files.select(F.col("repo_id").alias("__r"), *signs).groupBy("__r").agg(F.bool_or("auth").alias("has_auth"), F.bool_or("mail").alias("sends_mail"))
    mixed = F.col("path").isNotNull() & F.bool_or("guarded").over(Window.partitionBy("repo_id", "path"))
    rows = routes(files).withColumn("mixed", mixed).where("not guarded").join(repos, F.col("repo_id").eqNullSafe(F.col("__r"))).drop("__r")
    destructive = (F.col("method") == "delete") | ((F.col("method") != "get") & F.col("route").rlike(DESTRUCTIVE))
    mixed = F.coalesce("mixed", F.lit(False)) & F.col("language").isin(*INLINE)
    issue = F.when(destructive & (~F.col("has_auth") | mixed), "destructive").when(F.col("sends_mail") & ~F.col("has_auth") & ~F.col("method").isin("get", "delete"), "mail")
    return rows.select("repo_id", "path", "line_no", "method", "route", issue.alias("issue")).where("issue is not null")
