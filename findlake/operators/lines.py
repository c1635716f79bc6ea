"""Findings that single lines of files give: installs without a version, mutable references of pipelines, suppressions. Column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findlake.functions.supply import SHA, action_issue, java_issue
from findlake.sources.builds import maven_versions
from findlake.sources.parsers import parse

# fixed values: comments that switch a tool off, the rules they name in the first group
SUPPRESSIONS = {
    "ruff/flake8": r"#\s*noqa(?::\s*([A-Z]+[0-9]+(?:\s*,\s*[A-Z]+[0-9]+)*))?",
    "bandit": r"#\s*nosec(?:\s+([BG][0-9]+(?:[\s,]+[BG][0-9]+)*))?",
    "mypy": r"#\s*type:\s*ignore(?:\[([^\]]*)\])?",
    "pylint": r"#\s*pylint:\s*disable=([\w,-]+)",
    "eslint": r"eslint-disable(?:-next-line|-line)?(?:\s+([@\w/-]+(?:\s*,\s*[@\w/-]+)*))?",
    "clang-tidy": r"//\s*NOLINT(?:NEXTLINE)?(?:\(([^)]*)\))?",
}
# fixed values: what installs packages, and its own tools, whose version is no matter
INSTALL = r"^\s*(?:(?:RUN|sudo|-|run:)\s+)*(?:python3?\s+-m\s+)?(pip|pip3|npm|yarn|gem)\s+(?:install|i|add)\s+(.*)$"
TOOLCHAIN = ("pip", "setuptools", "wheel", "npm", "bundler")
# fixed values: how Gradle names a dependency, a plugin, the build's own version
COORDINATE = r"[\"']([\w.\-]+:[\w.\-]+):([^\"':@\s]+)(?:[:@][^\"']*)?[\"']"
PLUGIN = r"\bid\s*\(?\s*[\"']([\w.\-]+)[\"']\s*\)?\s+version\s*\(?\s*[\"']([^\"']+)[\"']"
OWN_VERSION = r"(?m)^\s*(?:project\.)?version\s*=\s*[\"']([^\"']+)[\"']"


def lines(files: DataFrame) -> DataFrame:
    """repo_id, path, line, line_no of every line."""
    return files.select("repo_id", "path", F.posexplode(F.split("content", "\n")).alias("at", "line")).select("repo_id", "path", "line", (F.col("at") + 1).alias("line_no"))


def unversioned_installs(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, manager, package of every package that a shell command installs without a version.

    A line is cut into its commands; options go, and a command that installs from a manifest (-r, -c, -e) names no packages.
    """
    commands = lines(files).where(F.col("line").rlike(r"\b(?:install|i|add)\s")).select("repo_id", "path", "line_no", F.explode(F.split("line", r"&&|\|\||;|\|")).alias("command"))
    parts = commands.select("repo_id", "path", "line_no", F.regexp_extract("command", INSTALL, 1).alias("manager"), F.regexp_extract("command", INSTALL, 2).alias("rest")).where("manager <> ''")
    parts = parts.where(~F.col("rest").rlike(r"(?:^|\s)-(?:r|c|e|-requirement|-constraint|-editable|v|-version)(?:[\s=]|$)"))
    words = parts.select("repo_id", "path", "line_no", F.replace("manager", F.lit("pip3"), F.lit("pip")).alias("manager"), F.explode(F.split(F.trim("rest"), r"\s+")).alias("package"))
    words = words.where(~F.col("package").rlike(r"^-|^[./~$]|://|^$") & ~F.col("package").isin(*TOOLCHAIN))
    versioned = F.when(F.col("manager") == "pip", F.col("package").rlike("[=<>~@]")).otherwise(F.col("package").rlike("^.[^@]*@"))
    return words.where(~versioned)


def workflow_actions(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, action, ref of every `uses:` whose action isn't at a full commit; local and container actions aren't judged."""
    uses = lines(files).select("repo_id", "path", "line_no", F.regexp_extract("line", r"^\s*-?\s*uses:\s*[\"']?([^\s\"'#]+)", 1).alias("uses"))
    open_ = uses.where(F.contains("uses", F.lit("@")) & (action_issue(F.col("uses")) != ""))
    return open_.select("repo_id", "path", "line_no", F.split_part("uses", F.lit("@"), F.lit(1)).alias("action"), F.regexp_extract("uses", "@(.*)$", 1).alias("ref"))


def hook_pins(files: DataFrame) -> DataFrame:
    """repo_id, path, hook, rev of every remote hook repository of a pre-commit file whose revision is no full commit."""
    entry = r"-\s*repo:\s*[\"']?([^\s\"'#]+)[\"']?\s*\n\s+rev:\s*[\"']?([^\s\"'#]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(entry), 1).alias("hook"), F.regexp_extract_all("content", F.lit(entry), 2).alias("rev"))
    found = files.where(F.contains("content", F.lit("rev:"))).select("repo_id", "path", F.explode(pairs).alias("p")).select("repo_id", "path", "p.hook", "p.rev")
    return found.where(~F.col("hook").isin("local", "meta") & ~F.col("rev").rlike(SHA))


def include_pins(files: DataFrame) -> DataFrame:
    """repo_id, path, project, ref of every project that a GitLab pipeline includes at no full commit; ref is empty where none is named."""
    entry = r"-\s*project:\s*[\"']?([^\s\"'#]+)[\"']?((?:\s*\n\s+(?:ref|file):[^\n]*)*)"
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(entry), 1).alias("project"), F.regexp_extract_all("content", F.lit(entry), 2).alias("rest"))
    found = files.where(F.contains("content", F.lit("project:"))).select("repo_id", "path", F.explode(pairs).alias("p"))
    found = found.select("repo_id", "path", "p.project", F.regexp_extract("p.rest", r"ref:\s*[\"']?([^\s\"'#]+)", 1).alias("ref"))
    return found.where(~F.col("ref").rlike(SHA))


def suppression_census(files: DataFrame) -> DataFrame:
    """repo_id, tool, n and blanket (those that name no rule) of the comments that switch a tool off; repositories without any have no row."""
    every = F.array(*[F.struct(F.lit(tool).alias("tool"), F.regexp_extract_all("line", F.lit(shape), 1).alias("rules")) for tool, shape in SUPPRESSIONS.items()])
    some = lines(files).where(F.col("line").rlike("|".join(SUPPRESSIONS.values())))
    found = some.select("repo_id", F.explode(every).alias("s")).select("repo_id", "s.tool", F.explode("s.rules").alias("rule"))
    return found.groupBy("repo_id", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("rule", F.lit("")) == "").alias("blanket"))


def gradle_pins(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, name, version, issue of what a Gradle build takes at no exact version.

    Snapshots count in a build whose own version is a release. Where the build locks its dependencies, by a lock file beside it
    or in its text, only snapshots do. Folders of lock files are joined by repository and folder.
    """
    builds = files.where(F.col("path").rlike(r"\.gradle(\.kts)?$"))
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    locks = files.where(F.col("path").rlike(r"(^|/)gradle\.lockfile$")).select(F.col("repo_id").alias("__r"), folder.alias("__d")).distinct().withColumn("__beside", F.lit(True))
    own = F.regexp_extract("content", OWN_VERSION, 1)
    of = builds.select("repo_id", "path", folder.alias("__folder"), own.rlike("(?i)^(?!.*-snapshot$).+").alias("released"), F.contains("content", F.lit("dependencyLocking")).alias("locks"), F.posexplode(F.split("content", "\n")).alias("at", "line"))
    of = of.withColumn("line", F.regexp_replace("line", r"(^|\s)//.*$", ""))
    named = lambda shape: F.arrays_zip(F.regexp_extract_all("line", F.lit(shape), 1).alias("name"), F.regexp_extract_all("line", F.lit(shape), 2).alias("version"))
    found = of.where(F.col("line").rlike(COORDINATE) | F.col("line").rlike(PLUGIN)).select("*", F.explode(F.concat(named(COORDINATE), named(PLUGIN))).alias("d"))
    found = found.withColumn("issue", java_issue(F.col("d.version"), F.col("released"))).where("issue <> ''")
    found = found.join(locks, F.col("repo_id").eqNullSafe(F.col("__r")) & (F.col("__folder") == F.col("__d")), "left")
    locked = F.col("locks") | F.coalesce("__beside", F.lit(False))
    return found.where(~locked | (F.col("issue") == "snapshot")).select("repo_id", "path", (F.col("at") + 1).alias("line_no"), "d.name", "d.version", "issue")


def maven_pins(files: DataFrame) -> DataFrame:
    """repo_id, path, coordinate, version (as written), issue of what a Maven project takes at no exact version."""
    rows = parse(files.where(F.contains("content", F.lit("<project"))), maven_versions, "coordinate string, raw string, version string, counts boolean")
    issue = java_issue(F.col("version"), F.col("counts"))
    return rows.select("repo_id", "path", "coordinate", F.col("raw").alias("version"), issue.alias("issue")).where("issue <> ''")
