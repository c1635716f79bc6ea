"""Unfinished functions, stores that only grow and open routes, over every document as the comment above a passage of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators import routes
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, files
from findlake.sources import gaps
from findlake.sources.parsers import parse

# a passage and what it holds: name, line in the passage, sensitive
STUBS = [
    ("def load():\n    pass\n", [("load", 1, False)]),
    ("def verify_token(t):\n    return True  # TODO check\n", [("verify_token", 1, True)]),
    ("class Store:\n    def put(self):\n        raise NotImplementedError\n    def on_close(self):\n        pass\n", [("put", 2, False)]),
    ("class BaseStore:\n    def put(self):\n        raise NotImplementedError\n", []),
    ("def skip():\n    pass  # nothing to release here\n", []),
    ("class A:\n    def go(self): ...\nclass B(A):\n    def go(self):\n        return 1\n", []),
    ("import abc\nclass C:\n    @abc.abstractmethod\n    def f(self):\n        pass\ndef g():\n    raise NotImplementedError('not here')\n", []),
    ("async def sync():\n    '''Later.'''\n    ...\n\ndef broken(:\n", []),
    ("def outer():\n    def is_allowed(u):\n        ...\n    return is_allowed\n", [("is_allowed", 2, True)]),
    ("def done(x):\n    return x\n", []),
]
# a passage and what it holds: field, line in the passage
STORES = [
    ("import uuid\nclass Q:\n    def __init__(self):\n        self.jobs = {}\n    def add(self, job):\n        job.id = uuid.uuid4()\n        self.jobs[job.id] = job\n", [("jobs", 7)]),
    ("import uuid\nclass Q:\n    def __init__(self):\n        self.jobs = {}\n    def add(self, job):\n        job.id = uuid.uuid4()\n        self.jobs[job.id] = job\n    def drop(self, k):\n        del self.jobs[k]\n", []),
    ("import uuid\nclass Q:\n    def __init__(self):\n        self.jobs = dict()\n    def add(self, job):\n        job.id = uuid.uuid4()\n        self.jobs[job.id] = job\n        if job.bad:\n            self.jobs.pop(job.id)\n", [("jobs", 7)]),
    ("import uuid\nclass Q:\n    def __init__(self):\n        self.jobs = {}\n    def add(self, job):\n        job.id = uuid.uuid4()\n        if len(self.jobs) >= 10:\n            raise ValueError\n        self.jobs[job.id] = job\n", []),
    ("class Q:\n    def __init__(self):\n        self.jobs = {}\n    def add(self, job):\n        self.jobs[job.id] = job\n", []),
    ("import uuid\nclass Q:\n    def __init__(self):\n        self.names = {}\n    def add(self, k):\n        self.names[k] = uuid.uuid4()\n", []),
]
LANGUAGES = ["go", "python", "javascript", "python", "java", "ruby", "go", "python"]
ROUTES = [
    'mux.HandleFunc("DELETE /files/{n}", s.remove)\nmux.HandleFunc("/send", s.send) // authed', '@app.delete("/jobs/<i>")\ndef drop(i):', "app.post('/mail', requireAdmin, send)\napp.delete('/mail/:id', drop)\nimport nodemailer",
    '@api.post("/notes")\ndef add(user=Depends(current_user)):\n    smtplib', '@DeleteMapping("/x/{id}")\nvoid drop() {}', "post '/purge/all' do\nend\nNet::SMTP", 'r.GET("/health", ok)\nr.POST("/admin/reset", reset)', '@login_required\n@app.put("/me")\ndef me(): ...',
]
FEW = 40


def _commented(spark: SparkSession, sf_dir: str, passages: list[tuple]) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(p) for p, _ in passages]), (F.col("doc_id") % len(passages) + 1).cast("int"))
    return files(spark, sf_dir).withColumn("content", F.concat(F.lit("# "), F.regexp_replace("content", r"[^\w .,-]+", "\n# "), F.lit("\n"), code))


def _commented_sql(passages: list[tuple], columns: str) -> str:
    """path and the known rows of each passage, behind as many lines as its document has."""
    known = ", ".join("(" + ", ".join([str(i), *(repr(v) for v in row)]) + ")" for i, (_, rows) in enumerate(passages) for row in rows)
    above = "len(string_split(regexp_replace(content, '[^\\w .,-]+', chr(10) || '# ', 'g'), chr(10)))"
    return f"WITH {FILES_SQL}, known(k, {columns}) AS (VALUES {known}), made AS (SELECT path, doc_id % {len(passages)} AS k, {above} AS above FROM files) SELECT path, {columns.replace('line', 'line + above AS line')} FROM made JOIN known USING (k)"


@query(_commented_sql(STUBS, "name, line, sensitive"))
def python_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_commented(spark, sf_dir, STUBS), gaps.python_stubs, "name string, line int, sensitive boolean").drop("repo_id")


@query(_commented_sql(STORES, "field, line"))
def growing_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(_commented(spark, sf_dir, STORES), gaps.python_growing_stores, "field string, line int").drop("repo_id")


def _quoted(texts) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


_SHAPES_SQL = ", ".join(f"({i}, {_quoted(languages)}, '{shape.replace(chr(39), chr(39) * 2)}')" for i, (languages, shape) in enumerate(routes.SHAPES))


@query(f"""WITH {FILES_SQL}, made AS (SELECT repo_id || '-' || doc_id % {FEW} AS repo_id, path, ({_quoted(LANGUAGES)})[doc_id % {len(ROUTES)} + 1] AS language, content || chr(10) || ({_quoted(ROUTES)})[doc_id % {len(ROUTES)} + 1] AS content FROM files),
shapes(n, languages, shape) AS (VALUES {_SHAPES_SQL}), repos AS (SELECT repo_id, bool_or(regexp_matches(content, '{routes.AUTH}')) AS has_auth, bool_or(regexp_matches(content, '{routes.MAIL}')) AS mails FROM made GROUP BY repo_id),
l AS (SELECT repo_id, path, language, unnest(string_split(content, chr(10))) AS raw, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM made), c AS (SELECT repo_id, path, language, line_no, regexp_replace(raw, '\\s(//|#).*$', '') AS line FROM l),
w AS (SELECT *, coalesce(string_agg(line, chr(10)) FILTER (regexp_matches(line, '^\\s*@')) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS above, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '') AS below FROM c),
h AS (SELECT w.*, arg_min(shape, n) AS shape FROM w JOIN shapes ON list_contains(languages, language) AND regexp_matches(line, shape) GROUP BY ALL),
r AS (SELECT *, coalesce(nullif(lower(regexp_extract(line, shape, 1)), ''), 'any') AS method, regexp_extract(line, shape, 2) AS route, regexp_extract(line, shape, 3) || CASE WHEN regexp_matches(line, '^\\s*@') THEN above || chr(10) || array_to_string(regexp_extract_all(below, '(?m)^\\s*@.*$'), ' ') || chr(10) || array_to_string(regexp_extract_all(below, '\\b(?:Depends|Security)\\(([^()]*)', 1), ' ') ELSE '' END AS context FROM h),
g AS (SELECT *, regexp_matches(replace(context, route, ''), '{routes.GUARD}') AS guarded FROM r), f AS (SELECT path, bool_or(guarded) AS mixed FROM g GROUP BY path),
i AS (SELECT g.repo_id, path, line_no, method, route, CASE WHEN (method = 'delete' OR method <> 'get' AND regexp_matches(route, '{routes.DESTRUCTIVE}')) AND (NOT has_auth OR mixed AND language IN ('go', 'typescript', 'javascript', 'python')) THEN 'destructive' WHEN mails AND NOT has_auth AND method NOT IN ('get', 'delete') THEN 'mail' END AS issue FROM g JOIN repos USING (repo_id) JOIN f USING (path) WHERE NOT guarded)
SELECT * FROM i WHERE issue IS NOT NULL""")
def open_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("doc_id") % len(ROUTES) + 1).cast("int")
    made = files(spark, sf_dir).withColumn("repo_id", F.concat("repo_id", F.lit("-"), (F.col("doc_id") % FEW).cast("string")))
    made = made.withColumn("language", F.element_at(F.array(*map(F.lit, LANGUAGES)), at)).withColumn("content", F.concat("content", F.lit("\n"), F.element_at(F.array(*map(F.lit, ROUTES)), at)))
    return routes.open_routes(made)
