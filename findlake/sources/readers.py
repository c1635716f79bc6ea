"""Sources: file trees, records, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what a file's suffix says of its language
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "java": "java", "rb": "ruby", "tf": "terraform", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
    "md": "markdown", "rst": "rst", "sh": "shell", "sql": "sql", "xml": "xml", "html": "html", "css": "css", "ini": "ini", "env": "dotenv", "txt": "text",
}
LARGEST = 2_000_000


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("unknown")
    for k, v in LANGUAGES.items():
        out = F.when(suffix == k, v).otherwise(out)
    return F.when(path.rlike("(^|/)Dockerfile[^/]*$"), "dockerfile").otherwise(out)


def role(path: Column, lang: Column) -> Column:
    """The first kind that fits, infrastructure before generated code."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.(tf|tfvars|hcl)$|\.template\.json$|(^|/)(k8s|kubernetes|helm|charts|terraform|cloudformation)/"), "iac")
        .when(p.rlike(r"(^|/)(dist|build|node_modules|vendor|generated)/|\.min\.(js|css)$|\.lock$|_pb2\.py$|\.g\.(dart|cs)$"), "generated")
        .when(p.rlike(r"(^|/)\.github/workflows/|(^|/)\.gitlab-ci|(^|/)jenkinsfile$|(^|/)\.circleci/"), "ci")
        .when(p.rlike(r"(^|/)(tests?|specs?|__tests__)/|(^|/)test_[^/]*\.py$|_test\.(go|py)$|\.(spec|test)\.[jt]sx?$"), "test")
        .when(p.rlike(r"(^|/)docs?/|(^|/)(readme|changelog|contributing)"), "docs")
        .when(lang.isin("yaml", "json", "toml", "ini", "dotenv"), "config")
        .when(lang.isin("markdown", "rst"), "docs")
        .when(lang == "unknown", "data")
        .otherwise("source")
    )


def tree(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """repo_id, path, language, role, size, content and skipped (why the content was not read, else null) of a folder's files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").split("://")[-1]
    rel = F.regexp_replace("path", "^[a-z]+:/*" + base.lstrip("/") + "/", "")
    head = F.substring("content", 1, 4096)
    marked = F.hex(F.substring("content", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    binary = (F.locate("\x00", F.decode(head, "ISO-8859-1")) > 0) & ~marked
    why = F.when(F.col("length") > LARGEST, "too large").when(binary, "binary")
    text = F.when(F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    out = rows.select(F.lit(repo_id).alias("repo_id"), rel.alias("path"), F.col("length").alias("size"), why.alias("skipped"), F.when(why.isNull(), F.regexp_replace(text, "^\ufeff", "")).alias("content"))
    return out.withColumn("language", language(F.col("path"))).withColumn("role", role(F.col("path"), F.col("language")))


def skipped(files: DataFrame) -> DataFrame:
    """reason and n of files that were not read, most first."""
    return files.where("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def history(spark: SparkSession, path: str, schema: str = "time timestamp, grade string, score double, coverage double, gate_passed boolean") -> DataFrame:
    """Rows of run histories, a JSON object a line; lines that don't parse or have no time drop out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED").where("time is not null")


def label_records(spark: SparkSession, path: str) -> DataFrame:
    """Label records, a JSON object a line (plain or gzip); an unknown label or role is an error."""
    schema = "finding_id string, rule_id string, label string, labeller string, role string, source string, language string, repo string, path string, line int, held_out boolean, stratum_size int, rule_population int"
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    known = F.col("label").isin("tp", "fp", "unsure") & F.col("role").isin("ground_truth", "mechanical", "adjudicator", "labeller")
    return rows.withColumn("label", F.when(known, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("label record with unknown label or role: "), F.to_json(F.struct("label", "role"))))))


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """name, category, real, cwe of a benchmark's expected results; lines that begin with # are comments."""
    return spark.read.schema("name string, category string, real boolean, cwe int").csv(path, comment="#")


def planned_resources(spark: SparkSession, path: str) -> DataFrame:
    """address, type, properties (variant) and unknown (array of top-level names only known later) of plan files."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    json = F.to_json(F.variant_get("doc", "$.planned_values.root_module.resources", "variant"))
    rows = doc.select("doc", F.explode(F.from_json(json, "array<struct<address:string,type:string,values:string>>")).alias("r"))
    changes = doc.select(F.explode(F.from_json(F.to_json(F.variant_get("doc", "$.resource_changes", "variant")), "array<struct<address:string,change:struct<after_unknown:map<string,string>>>>")).alias("c"))
    unknown = changes.select(F.col("c.address").alias("__address"), F.map_keys(F.map_filter("c.change.after_unknown", lambda _, v: v == "true")).alias("unknown"))
    out = rows.select("r.address", "r.type", F.parse_json("r.values").alias("properties"))
    return out.join(unknown, F.col("address") == F.col("__address"), "left").drop("__address").withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))


def pick(document: Column, path: str, kind: str = "string") -> Column:
    """One value of a parsed document by path; null where it isn't there."""
    return F.try_variant_get(document, path, kind)


def pick_any_case(document: Column, name: str, kind: str = "string") -> Column:
    """A top-level value by name, or by its first-letter-upper or lower-case spelling."""
    return F.coalesce(*[F.try_variant_get(document, f"$.{n}", kind) for n in dict.fromkeys((name, name[:1].upper() + name[1:], name.lower()))])


def required(document: Column, path: str) -> Column:
    """Like pick, but a missing path is an error: an analyzer whose output has another shape didn't find nothing."""
    return F.coalesce(F.try_variant_get(document, path, "string"), F.raise_error(F.lit(f"output without {path}")))
