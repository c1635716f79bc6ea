"""Resource rules over every part as a resource, and protections switched off in every document with a passage of code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findlake.operators import assets, checks_off
from findlake.plans.registry import query
from findlake.queries.base import FILES_SQL, files, table

# kind, native, provider, properties, unknown
SHAPES = [
    ("database", "aws_db_instance", "aws", '{"storage_encrypted": true, "publicly_accessible": "true", "deletion_protection": 1}', []),
    ("database", "aws_db_instance", "aws", '{"kms_key_id": "aws_kms_key.main.arn", "PubliclyAccessible": false}', ["deletion_protection"]),
    ("database", "azurerm_postgresql_server", "azure", '{"ssl_enforcement_enabled": false, "minimum_tls_version": "TLS1_0"}', []),
    ("database", "google_sql", "gcp", '{"settings": {"ip_configuration": {"require_ssl": "on"}}, "kms_key_name": "none"}', ["encrypted"]),
    ("object_store", "aws_s3_bucket", "aws", '{"acl": "public-read", "logging": [{"target": "x"}]}', []),
    ("object_store", "aws_s3_bucket", "aws", '{"acl": "public-read", "public_access_block": {"block_public_acls": true}, "encryption": {}}', []),
    ("object_store", "s3", "aws", '{"AccessControl": "PublicReadWrite", "LoggingConfiguration": {"DestinationBucketName": {"Ref": "part.7"}}}', []),
    ("object_store", "s3", "aws", '{"bucket": "b"}', ["acl"]),
    ("firewall", "aws_security_group", "aws", '{"ingress": [{"cidr_blocks": ["10.0.0.0/8", "0.0.0.0/0"]}], "egress": {}}', []),
    ("firewall", "aws_security_group", "aws", '{"egress": [{"cidr_blocks": ["0.0.0.0/0"]}]}', []),
    ("firewall", "aws_security_group", "aws", '{"SecurityGroupIngress": {"CidrIpv6": "::/0"}}', []),
    ("firewall_rule", "aws_security_group_rule", "aws", '{"type": "ingress", "cidr_blocks": ["0.0.0.0/0"]}', []),
    ("firewall_rule", "aws_security_group_rule", "aws", '{"type": "egress", "cidr_blocks": ["0.0.0.0/0"]}', ["ingress"]),
    ("listener", "aws_lb_listener", "aws", '{"protocol": "HTTP", "default_action": [{"type": "redirect"}]}', []),
    ("listener", "aws_lb_listener", "aws", '{"protocol": ["https", "tcp"]}', []),
    ("compute", "pod", "k8s", '{"spec": {"hostPID": true, "containers": [{"image": "a:latest", "securityContext": {"privileged": true, "runAsUser": 0}}]}}', []),
    ("compute", "pod", "k8s", '{"spec": {"containers": [{"image": "a:1", "resources": {"limits": {}}, "securityContext": {"allowPrivilegeEscalation": false, "readOnlyRootFilesystem": true, "runAsNonRoot": true, "capabilities": {"drop": ["ALL"]}}}]}}', []),
    ("compute", "azurerm_app_service", "azure", '{"https_only": "no", "min_tls_version": "1.1"}', []),
    ("queue", "aws_sqs_queue", "aws", "{}", ["kms_master_key_id"]),
    ("block_store", "claim", "k8s", "{}", []),
    ("block_store", "aws_ebs_volume", "aws", '{"encrypted": 0}', []),
    ("log_group", "aws_log", "aws", '{"retention_in_days": 30}', []),
    ("log_group", "aws_log", "aws", '{"retention_in_days": 0}', []),
]
OFF = [
    "requests.get(u, verify=False)", "if allow_insecure:\n    s.verify = False\n    x()", "tls.Config{InsecureSkipVerify: true,\n RootCAs: pool}", "c := tls.Config{\n VerifyPeerCertificate: f,\n InsecureSkipVerify: true}",
    "ok()  # verify=False", "curl -s --insecure https://h | wget --no-check-certificate x", "DEBUG = True", "agent({rejectUnauthorized: false}) // local", "ssh -o StrictHostKeyChecking=no h", "plain text", "CSRF_PROTECTION = False\ncheck_hostname = False\nca_certs = p",
]


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


_SHAPES_SQL = ", ".join(f"({i}, '{k}', '{n}', '{p}', json('{j.lower()}'), {_list(u)})" for i, (k, n, p, j, u) in enumerate(SHAPES))
_RULES_SQL = ", ".join(
    f"('{r.rule_id}', '{r.check}', '{r.severity}', {_list(r.kinds)}, {_list(p.lower() for p in r.properties)}, {_list(v.lower() for v in r.values)}, {_list(assets.needle(v) for v in r.values)}, {_list(r.providers)}, {_list(r.not_providers)}, {_list(r.natives)}, {_list(r.not_natives)}, {_list(r.unless_truthy)}, {_list(r.unless_referenced_by)}, {_list(assets.needle(v) for v in r.unless_text_present)})"
    for r in assets.RULES
)
_TRUTHY = "(x IN ('true', 'yes', '1', 'enabled', 'on') OR (try_cast(x AS DOUBLE) <> 0) OR (x[1] IN ('[', '{{') AND x NOT IN ('[]', '{{}}')))".replace("{{", "{").replace("}}", "}")


@query(f"""WITH shapes(k, kind, native, provider, j, unknown) AS (VALUES {_SHAPES_SQL}),
rules(rule_id, how, severity, kinds, props, vals, needles, providers, no_providers, natives, no_natives, u_truthy, u_ref, u_text) AS (VALUES {_RULES_SQL}),
a AS (SELECT p_brand AS repo_id, 'part.' || p_partkey AS address, s.* FROM part JOIN shapes s ON s.k = p_partkey % {len(SHAPES)}),
refs AS (SELECT DISTINCT repo_id, coalesce(json_extract_string(j, '$.loggingconfiguration.destinationbucketname.ref'), json_extract_string(j, '$.loggingconfiguration.destinationbucketname')) AS target, address AS source FROM a),
m AS (SELECT shapes.*, rules.* FROM shapes JOIN rules ON list_contains(kinds, kind) AND (len(providers) = 0 OR list_contains(providers, provider)) AND NOT list_contains(no_providers, provider) AND (len(natives) = 0 OR list_contains(natives, native)) AND NOT list_contains(no_natives, native)),
g AS (SELECT k, rule_id, unnest(props) AS p FROM m), v AS (SELECT g.k, rule_id, p, json_extract_string(j, '$.' || p) AS x, json_type(json_extract(j, '$.' || p)) AS t, j, unknown FROM g JOIN shapes USING (k)),
s AS (SELECT v.k, v.rule_id, bool_or(coalesce({_TRUTHY}, false)) AS truthy,
  bool_or(coalesce(regexp_matches(p, '(^|[._])({"|".join(assets.REFERENCES)})$') AND NOT list_contains({_list(assets.NOTHING)}, x), false)) AS present,
  bool_or(coalesce(CASE WHEN t = 'ARRAY' THEN list_has_any(from_json(x, '["VARCHAR"]'), rules.vals) ELSE list_contains(rules.vals, x) END, false)) AS bad,
  bool_or(list_contains(unknown, p) OR list_contains(unknown, string_split(p, '.')[1])) AS open FROM v JOIN rules USING (rule_id) GROUP BY ALL),
e AS (SELECT m.k, m.rule_id, how, severity, coalesce(truthy, false) AS truthy, coalesce(present, false) AS present, coalesce(bad, false) AS bad, coalesce(open, false) AS open, u_ref,
  len(list_filter(needles, lambda n: contains(j::VARCHAR, n))) > 0 AS said, len(list_filter(u_text, lambda n: contains(j::VARCHAR, n))) > 0 OR coalesce(list_has_any(list_transform(u_truthy, lambda p: json_extract_string(j, '$.' || p)), ['true', 'yes', '1']), false) AS settled,
  regexp_matches(regexp_replace(j::VARCHAR, '"egress":[^\\]]*\\]', '') , '0[.]0[.]0[.]0/0|::/0') AND NOT coalesce(json_extract_string(j, '$.type') = 'egress', false) AS wide FROM m LEFT JOIN s ON s.k = m.k AND s.rule_id = m.rule_id)
SELECT a.repo_id, a.address, e.rule_id, severity, CASE WHEN settled OR (len(u_ref) > 0 AND EXISTS (SELECT 1 FROM refs r WHERE r.repo_id = a.repo_id AND r.target = a.address AND r.source <> a.address)) THEN 'satisfied'
  WHEN how = 'property_truthy' THEN CASE WHEN truthy OR present THEN 'satisfied' WHEN open THEN 'unknown' ELSE 'violated' END
  WHEN how = 'property_absent_or_false' THEN CASE WHEN truthy THEN 'violated' WHEN open THEN 'unknown' ELSE 'satisfied' END
  WHEN how = 'property_not_in' THEN CASE WHEN bad THEN 'violated' WHEN open THEN 'unknown' ELSE 'satisfied' END
  WHEN how = 'no_open_ingress' THEN CASE WHEN wide THEN 'violated' WHEN open THEN 'unknown' ELSE 'satisfied' END
  WHEN how = 'text_absent' THEN CASE WHEN said THEN 'violated' ELSE 'satisfied' END ELSE CASE WHEN said THEN 'satisfied' ELSE 'violated' END END AS outcome
FROM a JOIN e ON e.k = a.k""")
def resource_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("native"), F.lit(p).alias("provider"), F.lit(j).alias("properties"), F.array(*map(F.lit, u)).cast("array<string>").alias("unknown")) for k, n, p, j, u in SHAPES]), (F.col("p_partkey") % len(SHAPES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo_id"), F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("address"), shape.alias("s"))
    return assets.evaluate(rows.select("repo_id", "address", "s.*"))


_OFF_SQL = ", ".join(f"('{shape.replace(chr(39), chr(39) * 2)}', '{title}', '{severity}')" for shape, title, severity in checks_off.OFF)


@query(f"""WITH {FILES_SQL}, made AS (SELECT repo_id, CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE 'src/' END || path AS path, content || chr(10) || ({_list(OFF)})[doc_id % {len(OFF)} + 1] AS content FROM files), off(shape, title, base) AS (VALUES {_OFF_SQL}),
l AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM made), c AS (SELECT repo_id, path, line_no, regexp_replace(line, '{checks_off.COMMENT}', '') AS line FROM l),
w AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS before, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), '') AS after FROM c),
h AS (SELECT *, CASE WHEN regexp_matches(path, '{checks_off.DEVELOPMENT}') THEN 'path' WHEN regexp_matches(before, '{checks_off.OPT_IN}') THEN 'guard' WHEN contains(title, 'TLS') AND regexp_matches(after, '{checks_off.OTHER_WAY}') THEN 'compensated' ELSE '' END AS softened
  FROM w JOIN off ON regexp_matches(line, shape) WHERE NOT (contains(shape, 'InsecureSkipVerify') AND regexp_matches(before || after, '{checks_off.REPLACED}')))
SELECT repo_id, path, line_no, title, CASE WHEN softened IN ('path', 'guard') THEN 'low' WHEN softened = 'compensated' THEN 'medium' ELSE base END AS severity, softened FROM h""")
def disabled_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    passage = F.element_at(F.array(*map(F.lit, OFF)), (F.col("doc_id") % len(OFF) + 1).cast("int"))
    made = files(spark, sf_dir).withColumn("path", F.concat(F.when(F.col("doc_id") % 7 == 0, "tests/").otherwise("src/"), F.col("path"))).withColumn("content", F.concat("content", F.lit("\n"), passage))
    return checks_off.disabled_checks(made)
