"""Protections that code switches off, with what softens them: a test or development path, an opt-in, another way of checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what is switched off, its title and severity
OFF = [
    (r"\bverify\s*=\s*False\b", "TLS certificate verification disabled", "high"),
    (r"\brejectUnauthorized\s*:\s*false\b", "TLS certificate verification disabled", "high"),
    (r"\bInsecureSkipVerify\s*:\s*true\b", "TLS certificate verification disabled", "high"),
    (r"\bNODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0", "TLS verification disabled process-wide", "high"),
    (r"\bssl\._create_unverified_context\b", "Unverified TLS context", "high"),
    (r"\bStrictHostKeyChecking[= ]+no\b", "SSH host-key checking disabled", "high"),
    (r"\bAutoAddPolicy\s*\(\s*\)", "SSH host keys accepted automatically", "medium"),
    (r"\bcheck_hostname\s*=\s*False\b", "TLS hostname check disabled", "high"),
    (r"\bcurl\b[^\n]*\s(?:-k|--insecure)\b", "curl invoked without certificate checking", "medium"),
    (r"\bwget\b[^\n]*--no-check-certificate\b", "wget invoked without certificate checking", "medium"),
    (r"\bCSRF_?(?:ENABLED|PROTECTION)\s*[:=]\s*(?:False|false|0)\b", "CSRF protection disabled", "high"),
    (r"\bDEBUG\s*=\s*True\b", "Debug mode enabled", "medium"),
]
# fixed values: paths of tests and development, conditions that name the opt-in, other ways of checking, checks replaced by one's own
DEVELOPMENT = r"(^|/)(tests?|testing|fixtures?|examples?|samples?|local|dev|development|docker-compose\.(?:dev|local))"
OPT_IN = r"(?im)^[ \t]*(?:if|elif|unless|when)\b[^\n]{0,120}?\b(insecure|skip_?verify|skip_?tls|no_?verify|allow_?insecure|disable_?tls|dev_?mode|development|debug|self_?signed|trust_?all)\b"
OTHER_WAY = r"(?i)\b(RootCAs|ca_certs?|cafile|ca_bundle|CABundle|ServerName|Certificates\s*:|ClientCert|cert_?file|VerifyPeerCertificate|VerifyConnection|pinned?_?(?:cert|key))\b"
REPLACED = r"\b(?:VerifyPeerCertificate|VerifyConnection)\b"
BEFORE, AFTER = 6, 8
COMMENT = r"(^|\s)(#|//).*$"


def disabled_checks(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, title, severity, softened (path, guard, compensated or empty) of every protection that a line switches off.

    Comments don't count. A file's lines stay one array, so the lines around a hit need no window; only files that hold a
    hit are cut into lines at all. Files without content have no rows.
    """
    anything = "|".join(f"(?:{shape})" for shape, _, _ in OFF)
    code = F.transform(F.split("content", "\n"), lambda line: F.regexp_replace(line, COMMENT, ""))
    some = files.where(F.col("content").rlike(anything)).select("repo_id", "path", code.alias("code"))
    spots = F.filter(F.sequence(F.lit(1), F.size("code")), lambda i: F.element_at("code", i).rlike(anything))

    def around(i: Column) -> Column:
        first = F.greatest(i - BEFORE, F.lit(1))
        return F.struct(
            i.alias("line_no"), F.element_at("code", i).alias("line"),
            F.array_join(F.slice("code", first, i - first + 1), "\n").alias("before"), F.array_join(F.slice("code", i + 1, F.lit(AFTER)), "\n").alias("after"),
        )

    hits = some.select("repo_id", "path", F.explode(F.transform(spots, around)).alias("h")).select("repo_id", "path", "h.*")
    kinds = F.array_compact(F.array(*[F.when(F.col("line").rlike(shape), F.struct(F.lit(title).alias("title"), F.lit(severity).alias("base"), F.lit("InsecureSkipVerify" in shape).alias("replaceable"))) for shape, title, severity in OFF]))
    found = hits.withColumn("k", F.explode(kinds)).select("*", "k.*")
    found = found.where(~(F.col("replaceable") & (F.col("before").rlike(REPLACED) | F.col("after").rlike(REPLACED))))
    softened = F.when(F.col("path").rlike(DEVELOPMENT), "path").when(F.col("before").rlike(OPT_IN), "guard").when(F.col("title").contains("TLS") & F.col("after").rlike(OTHER_WAY), "compensated").otherwise("")
    found = found.withColumn("softened", softened)
    severity = F.when(F.col("softened").isin("path", "guard"), "low").when(F.col("softened") == "compensated", "medium").otherwise(F.col("base"))
    return found.select("repo_id", "path", "line_no", "title", severity.alias("severity"), "softened")
