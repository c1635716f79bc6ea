"""Queries over single lines. The documents hold no code, so each gets one more passage of it, by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators import lines
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, files

INSTALLS = ["pip install requests", "RUN pip3 install flask jinja2==3.1 -q", "pip install -r requirements.txt", "npm install left-pad @a/b @a/c@1.0.0", "npm install left-pad@1.3.0", "sudo gem install rake", "npm ci", "apt-get update && python -m pip install --upgrade pip ruff; true", "pip install ./local git+https://h/x"]
SHA = "0123456789abcdef0123456789abcdef01234567"
USES = ["  - uses: actions/checkout@v4", f"  - uses: a/b@{SHA}", "    uses: ./local/action", '  - uses: "docker://alpine:3"', "  - uses: org/act/sub@main # why"]
HOOKS = ["- repo: https://h/ruff\n  rev: v0.4.1\n- repo: local\n  rev: x", f"- repo: https://h/black\n  rev: {SHA}", "- repo: 'https://h/mypy'\n    rev: 'main'"]
INCLUDES = ["  - project: g/tools\n    ref: main\n    file: a.yml", f"  - project: 'g/t2'\n    file: b.yml\n    ref: {SHA}", "  - project: g/none\n    file: c.yml", "  - local: d.yml"]
MARKS = ["x = 1  # noqa", "y = 2  # noqa: E501, F401  # type: ignore[arg-type]", "z()  # nosec B101", "// eslint-disable-next-line no-eval", "/* eslint-disable */ int a; // NOLINT", "# pylint: disable=broad-except", "plain line"]
GRADLE = ["version = '1.0'\nimplementation 'a.b:c:1.+'\n// api 'x:y:latest.release'\napi \"a:d:2.0-SNAPSHOT\"", "implementation('g:h:[1.0,2.0)')\nid 'org.p' version 'latest.release'", "version = '2-SNAPSHOT'\napi 'a:d:2.0-SNAPSHOT'\napi 'a:e:1.2.3@jar'", "dependencyLocking { lockAllConfigurations() }\nversion = '3'\napi 'a:b:+'\napi 'a:c:1-SNAPSHOT'", "api \"a:b:${v}\"; runtimeOnly 'k:l:1.+', 'm:n:RELEASE'"]
_POM = "<project xmlns='http://maven.apache.org/POM/4.0.0'><groupId>o.x</groupId><version>{}</version><properties><v>{}</v></properties><dependencies><dependency><groupId>{}</groupId><artifactId>a</artifactId><version>${{v}}</version></dependency></dependencies></project>"
# a project's own version, a property, the group of the dependency that uses it, what is wrong with it
POMS = [("1.0", "[1,2)", "g.h", "range"), ("1.0", "2-SNAPSHOT", "g.h", "snapshot"), ("1.0", "2-SNAPSHOT", "o.x.sub", ""), ("1-SNAPSHOT", "2-SNAPSHOT", "g.h", ""), ("1.0", "LATEST", "o.x", "dynamic"), ("1.0", "1.2.3", "g.h", ""), ("${revision}", "2-SNAPSHOT", "g.h", ""), ("1.0", "${unset}", "g.h", ""), ("1.0", "${w}.+", "g.h", "")]


def _with(spark: SparkSession, sf_dir: str, passages: list[str]) -> DataFrame:
    more = F.element_at(F.array(*map(F.lit, passages)), (F.col("doc_id") % len(passages) + 1).cast("int"))
    return files(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n"), more))


def _sql(passages: list[str]) -> str:
    """CTEs made (the files with their passage) and l (their lines)."""
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in passages)
    return f"{FILES_SQL}, made AS (SELECT repo_id, path, content || chr(10) || [{listed}][doc_id % {len(passages)} + 1] AS content FROM files), l AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM made)"


@query(f"""WITH {_sql(INSTALLS)}, c AS (SELECT path, line_no, unnest(string_split_regex(line, '&&|[|][|]|;|[|]')) AS command FROM l),
p AS (SELECT path, line_no, regexp_extract(command, '{lines.INSTALL}', 1) AS m, regexp_extract(command, '{lines.INSTALL}', 2) AS rest FROM c),
w AS (SELECT path, line_no, replace(m, 'pip3', 'pip') AS manager, unnest(string_split_regex(trim(rest), '\\s+')) AS package FROM p WHERE m <> '' AND NOT regexp_matches(rest, '(^|\\s)-(r|c|e|-requirement|-constraint|-editable|v|-version)([\\s=]|$)'))
SELECT path, line_no, manager, package FROM w WHERE package <> '' AND NOT regexp_matches(package, '^-|^[./~$]|://') AND package NOT IN ('pip', 'setuptools', 'wheel', 'npm', 'bundler') AND NOT CASE manager WHEN 'pip' THEN regexp_matches(package, '[=<>~@]') ELSE regexp_matches(package, '^.[^@]*@') END""")
def unversioned_installs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.unversioned_installs(_with(spark, sf_dir, INSTALLS)).drop("repo_id")


@query(f"""WITH {_sql(USES)}, u AS (SELECT path, line_no, regexp_extract(line, '^\\s*-?\\s*uses:\\s*["'']?([^\\s"''#]+)', 1) AS uses FROM l)
SELECT path, line_no, string_split(uses, '@')[1] AS action, string_split(uses, '@')[2] AS ref FROM u WHERE contains(uses, '@') AND NOT regexp_matches(uses, '^[.]{{0,2}}/|^docker://|@[0-9a-fA-F]{{40}}$')""")
def workflow_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.workflow_actions(_with(spark, sf_dir, USES)).drop("repo_id")


@query(f"""WITH {_sql(HOOKS)}, h AS (SELECT path, line_no, regexp_extract(line, 'repo:\\s*["'']?([^\\s"''#]+)', 1) AS hook, regexp_extract(lead(line) OVER (PARTITION BY path ORDER BY line_no), '^\\s+rev:\\s*["'']?([^\\s"''#]+)', 1) AS rev FROM l)
SELECT path, hook, rev FROM h WHERE hook NOT IN ('', 'local', 'meta') AND rev <> '' AND NOT regexp_matches(rev, '^[0-9a-fA-F]{{40}}$')""")
def hook_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.hook_pins(_with(spark, sf_dir, HOOKS)).drop("repo_id")


@query(f"""WITH {_sql(INCLUDES)}, p AS (SELECT path, max(regexp_extract(line, 'project:\\s*["'']?([^\\s"''#]+)', 1)) AS project, max(regexp_extract(line, '^\\s+ref:\\s*["'']?([^\\s"''#]+)', 1)) AS ref FROM l GROUP BY path)
SELECT path, project, ref FROM p WHERE project <> '' AND NOT regexp_matches(ref, '^[0-9a-fA-F]{{40}}$')""")
def include_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.include_pins(_with(spark, sf_dir, INCLUDES)).drop("repo_id")


_TOOLS = ", ".join(f"('{tool}', '{shape}')" for tool, shape in lines.SUPPRESSIONS.items())


@query(f"""WITH {_sql(MARKS)}, tools(tool, shape) AS (VALUES {_TOOLS}), f AS (SELECT repo_id, tool, unnest(regexp_extract_all(line, shape, 1)) AS rule FROM l JOIN tools ON regexp_matches(line, shape))
SELECT repo_id, tool, count(*) AS n, count(*) FILTER (coalesce(rule, '') = '') AS blanket FROM f GROUP BY repo_id, tool""")
def suppression_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.suppression_census(_with(spark, sf_dir, MARKS))


_ISSUE = "CASE WHEN contains(version, '$') THEN '' WHEN version IN ('RELEASE', 'LATEST') OR starts_with(version, 'latest.') OR regexp_matches(version, '^[\\w.-]*[+]$') THEN 'dynamic' WHEN version[1] IN ('[', '(') THEN 'range' WHEN ends_with(version, '-SNAPSHOT') AND released THEN 'snapshot' ELSE '' END"


@query(f"""WITH {_sql(GRADLE)}, own AS (SELECT path, regexp_extract(content, '(?m)^version = ''([^'']+)''', 1) AS v, contains(content, 'dependencyLocking') OR string_split(string_split(path, '/')[2], '.')[1]::INT % 3 = 0 AS locked FROM made),
c AS (SELECT path, line_no, regexp_replace(line, '(^|\\s)//.*$', '') AS line FROM l), d AS (SELECT path, line_no, unnest(regexp_extract_all(line, '["''][\\w.-]+:[\\w.-]+:[^"'':@\\s]+(?:@[^"'']*)?["'']')) AS d FROM c),
n AS (SELECT path, line_no, regexp_extract(d, '^.([^:]+:[^:]+):', 1) AS name, regexp_extract(d, '^.[^:]+:[^:]+:([^"''@]+)', 1) AS version FROM d UNION ALL SELECT path, line_no, regexp_extract(line, 'id ''([^'']+)'' version ''', 1), regexp_extract(line, 'id ''[^'']+'' version ''([^'']+)''', 1) FROM c WHERE regexp_matches(line, 'id ''[^'']+'' version ''')),
i AS (SELECT n.*, locked, v <> '' AND NOT ends_with(v, '-SNAPSHOT') AS released FROM n JOIN own USING (path)), j AS (SELECT *, {_ISSUE} AS issue FROM i) SELECT string_split(path, '.')[1] || '/build.gradle' AS path, line_no, name, version, issue FROM j WHERE issue = 'snapshot' OR issue <> '' AND NOT locked""")
def gradle_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.regexp_extract("path", r"^(.*)\.txt$", 1)
    builds = _with(spark, sf_dir, GRADLE)
    locks = builds.where("doc_id % 3 = 0").withColumn("path", F.concat(folder, F.lit("/gradle.lockfile"))).withColumn("content", F.lit(""))
    return lines.gradle_pins(builds.withColumn("path", F.concat(folder, F.lit("/build.gradle"))).unionByName(locks)).drop("repo_id")


@query(f"""WITH {FILES_SQL}, poms(k, grp, version, issue) AS (VALUES {', '.join(f"({i}, '{g}', '${{v}}', '{issue}')" for i, (_, _, g, issue) in enumerate(POMS))}) SELECT path, grp || ':a' AS coordinate, version, issue FROM files JOIN poms ON k = doc_id % {len(POMS)} WHERE issue <> ''""")
def maven_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pom = F.element_at(F.array(*[F.lit(_POM.format(*p[:3])) for p in POMS]), (F.col("doc_id") % len(POMS) + 1).cast("int"))
    made = files(spark, sf_dir).withColumn("content", F.concat(F.lit("<!-- "), F.regexp_replace("content", "[^A-Za-z0-9 ]+", " "), F.lit(" -->\n"), pom))
    return lines.maven_pins(made).drop("repo_id")
