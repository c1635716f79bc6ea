"""Rules over infrastructure resources: one scan decides every rule, with a third outcome for what a plan leaves open."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what counts as true, what names nothing, properties that hold an identifier, the whole internet, where ingress is written
TRUE = ("true", "yes", "1", "enabled", "on")
NOTHING = ("", "none", "null", "nil", "false", "0", "-", "n/a", "[]", "{}")
REFERENCES = ("kms_key_id", "kms_key_arn", "kms_key_name", "kms_key_self_link", "kms_master_key_id", "key_vault_key_id", "encryption_key_name", "disk_encryption_set_id", "disk_encryption_key", "customer_managed_key", "encryption_settings", "default_kms_key_name", "encryption_config", "server_side_encryption_configuration", "bucketencryption")
OPEN_RANGES = ("0.0.0.0/0", "::/0")
INGRESS = ("ingress", "securitygroupingress", "ingress_rules")
RANGES = ("cidr_blocks", "cidrip", "cidr_ipv6", "cidripv6", "ipv6_cidr_blocks")


@dataclass(frozen=True)
class AssetRule:
    """What must hold for resources of some kinds. `check` is one of the seven kinds of assertion that `outcome` knows.

    properties are dotted paths, in any case; a satisfied unless_* settles the rule before the assertion is read.
    """

    rule_id: str
    check: str
    severity: str
    kinds: tuple[str, ...]
    properties: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    providers: tuple[str, ...] = ()
    not_providers: tuple[str, ...] = ()
    natives: tuple[str, ...] = ()
    not_natives: tuple[str, ...] = ()
    unless_truthy: tuple[str, ...] = ()
    unless_referenced_by: tuple[str, ...] = ()
    unless_text_present: tuple[str, ...] = ()


# fixed values: the shipped rules
RULES = [
    AssetRule("unencrypted-database", "property_truthy", "high", ("database",), ("storage_encrypted", "storageencrypted", "encrypted", "kms_key_id", "kmskeyid", "encryptionatrestoptions.enabled", "ssespecification.sseenabled", "transparent_data_encryption_enabled", "infrastructure_encryption_enabled", "customer_managed_key.key_vault_key_id", "customer_managed_key", "encryption_key_name", "kms_key_name", "encryption.kms_key_name", "disk_encryption_key.kms_key_name", "encryption_config.kms_key_name"), not_natives=("azurerm_postgresql_server", "azurerm_mysql_server", "azurerm_postgresql_flexible_server", "azurerm_mysql_flexible_server")),
    AssetRule("unencrypted-object-store", "property_truthy", "medium", ("object_store",), ("server_side_encryption_configuration", "bucketencryption", "encryption", "sse_algorithm", "encryption_config", "customer_managed_key", "infrastructure_encryption_enabled", "encryption.default_kms_key_name", "default_kms_key_name")),
    AssetRule("unencrypted-volume", "property_truthy", "high", ("block_store", "filesystem"), ("encrypted", "kms_key_id", "kmskeyid", "disk_encryption_set_id", "encryption_settings", "disk_encryption_key", "disk_encryption_key.kms_key_self_link", "kms_key_name"), not_providers=("k8s",)),
    AssetRule("unencrypted-queue", "property_truthy", "medium", ("queue", "topic"), ("kms_master_key_id", "kmsmasterkeyid", "sqs_managed_sse_enabled", "sqsmanagedsseenabled", "kms_key_name", "customer_managed_key", "encryption")),
    AssetRule("public-object-store", "property_not_in", "critical", ("object_store",), ("acl", "accesscontrol"), ("public-read", "public-read-write", "PublicRead", "PublicReadWrite", "authenticated-read"), unless_truthy=("public_access_block.block_public_acls", "publicaccessblockconfiguration.blockpublicacls")),
    AssetRule("database-publicly-accessible", "property_absent_or_false", "critical", ("database",), ("publicly_accessible", "publiclyaccessible", "public_network_access_enabled", "public_network_access")),
    AssetRule("unrestricted-ingress", "no_open_ingress", "high", ("firewall", "firewall_rule"), ("ingress", "securitygroupingress", "ingress_rules", "cidr_blocks", "type")),
    AssetRule("plaintext-listener", "property_not_in", "high", ("listener",), ("protocol",), ("HTTP", "TCP"), unless_text_present=('"type": "redirect"',)),
    AssetRule("database-allows-plaintext-connections", "property_truthy", "high", ("database",), ("ssl_enforcement_enabled", "ssl_enforcement", "require_ssl", "settings.ip_configuration.require_ssl", "enforce_ssl", "tls_enforced", "ssl_mode", "minimum_tls_version", "ssl_action"), providers=("azure", "gcp", "alicloud"), not_natives=("azurerm_mssql_database", "azurerm_mssql_server", "azurerm_sql_database", "azurerm_sql_server", "azurerm_cosmosdb_account")),
    AssetRule("weak-tls-version", "property_not_in", "medium", ("database", "object_store", "load_balancer", "listener", "compute", "search"), ("minimum_tls_version", "min_tls_version", "minimumtlsversion", "tls_policy", "tlssecuritypolicy", "ssl_policy", "security_policy", "minimum_protocol_version", "minimumprotocolversion"), ("1.0", "1.1", "TLS1_0", "TLS1_1", "TLSv1", "TLSv1.1", "TLSv1_2016", "Policy-Min-TLS-1-0-2019-07", "Policy-Min-TLS-1-1-2019-07", "ELBSecurityPolicy-TLS-1-0-2015-04", "SSLv3", "TLS_1_0", "TLS_1_1")),
    AssetRule("no-https-redirect", "property_truthy", "medium", ("listener", "compute"), ("https_only", "httpsonly", "redirect_http_to_https", "force_https", "https_redirect", "ssl_redirect"), natives=("azurerm_app_service", "azurerm_linux_web_app", "azurerm_windows_web_app", "aws_api_gateway_domain_name", "google_compute_target_http_proxy")),
    AssetRule("no-log-retention", "property_truthy", "low", ("log_group",), ("retention_in_days", "retentionindays", "retention_policy.days", "retention_days")),
    AssetRule("no-object-store-logging", "property_truthy", "low", ("object_store",), ("logging", "loggingconfiguration", "logging_config", "logs", "enabled_log", "log_config", "logging_service"), not_providers=("azure",), unless_referenced_by=("loggingconfiguration.destinationbucketname",)),
    AssetRule("no-deletion-protection", "property_truthy", "low", ("database",), ("deletion_protection", "deletionprotection", "deletionprotectionenabled", "deletion_protection_enabled", "prevent_deletion", "lifecycle.prevent_destroy"), not_providers=("azure",)),
    AssetRule("privileged-container", "text_absent", "high", ("compute",), values=('"privileged": true', "privileged: true")),
    AssetRule("host-network", "text_absent", "medium", ("compute",), values=('"hostNetwork": true', "hostNetwork: true")),
    AssetRule("k8s-privilege-escalation", "text_absent", "high", ("compute",), values=('"allowprivilegeescalation": true',), providers=("k8s",)),
    AssetRule("k8s-host-namespace", "text_absent", "high", ("compute",), values=('"hostpid": true', '"hostipc": true'), providers=("k8s",)),
    AssetRule("k8s-host-path-volume", "text_absent", "medium", ("compute",), values=('"hostpath"',), providers=("k8s",)),
    AssetRule("k8s-runs-as-root", "text_absent", "medium", ("compute",), values=('"runasuser": 0',), providers=("k8s",)),
    AssetRule("k8s-dangerous-capabilities", "text_absent", "high", ("compute",), values=('"sys_admin"', '"net_admin"', '"sys_ptrace"', '"sys_module"'), providers=("k8s",)),
    AssetRule("k8s-mutable-image-tag", "text_absent", "low", ("compute",), values=(':latest"',), providers=("k8s",)),
    AssetRule("k8s-no-resource-limits", "text_present", "low", ("compute",), values=('"limits"',), providers=("k8s",)),
    AssetRule("k8s-no-security-context", "text_present", "medium", ("compute",), values=('"securitycontext"',), providers=("k8s",)),
    AssetRule("k8s-privilege-escalation-not-disabled", "text_present", "medium", ("compute",), values=('"allowprivilegeescalation": false',), providers=("k8s",)),
    AssetRule("k8s-not-run-as-non-root", "text_present", "medium", ("compute",), values=('"runasnonroot": true',), providers=("k8s",)),
    AssetRule("k8s-writable-root-filesystem", "text_present", "low", ("compute",), values=('"readonlyrootfilesystem": true',), providers=("k8s",)),
    AssetRule("k8s-capabilities-not-dropped", "text_present", "low", ("compute",), values=('"drop"',), providers=("k8s",)),
]


def needle(text: str) -> str:
    """Lower case, without the blank after a key, as compact JSON has it."""
    return text.lower().replace('": ', '":')


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _texts(values) -> str:
    return "array(" + ", ".join("'" + v.lower().replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values) + ")"


def _meets(column: str, values) -> Column:
    """An array column shares an element with the texts."""
    return F.expr(f"arrays_overlap({column}, {_texts(values)})") if values else F.lit(False)


def _says(values) -> Column:
    return F.expr(f"exists({_texts(map(needle, values))}, n -> contains(__text, n))") if values else F.lit(False)


def _at(path: str) -> Column:
    return F.try_variant_get("__v", "$." + path.lower(), "string")


def _truthy(value: Column) -> Column:
    number = value.rlike(r"^-?[0-9.]+$") & ~value.rlike(r"^-?[0.]+$")
    filled = value.rlike(r"^[\[{]") & ~value.isin("[]", "{}")
    return F.trim(value).isin(*TRUE) | number | filled


def _identifiers(paths) -> list[str]:
    """Those of the paths whose value is an identifier: that it is there counts as true."""
    return [p for p in paths if any(p == name or p.endswith(("." + name, "_" + name)) for name in REFERENCES)]


def _among(value: Column, bad: list[str]) -> Column:
    """The value, or one of a list's, is among the texts."""
    listed = F.coalesce(F.from_json(F.when(value.startswith("["), value), "array<string>"), F.array(value))
    return F.coalesce(F.arrays_overlap(listed, F.array(*map(F.lit, bad))), F.lit(False))


def _open_ingress() -> Column:
    blocks = F.from_json(F.col("__block"), "array<map<string,string>>")
    return F.exists(F.coalesce(blocks, F.array().cast("array<map<string,string>>")), lambda b: _any([_among(b[r], list(OPEN_RANGES)) for r in RANGES]))


def _blocks() -> Column:
    """Every ingress block as one JSON array of objects; a rule that is a resource of its own is its own block."""
    parts = []
    for key in INGRESS:
        one = _at(key)
        parts.append(F.when(one.startswith("[{"), F.substring(one, 2, 1 << 30).substr(F.lit(1), F.length(one) - 2)).when(one.startswith("{"), one))
    own = F.col("native").endswith("security_group_rule") & (_at("type") == "ingress")
    parts.append(F.when(own, F.col("__text")))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def outcome(rule: AssetRule) -> Column:
    """satisfied, violated or unknown: what rests on a value that isn't known before the plan is applied is unknown, not violated."""
    props = [p.lower() for p in rule.properties]
    undecided = _meets("__unknown", [*props, *(p.split(".")[0] for p in props)])
    if rule.check == "property_truthy":
        state = F.when(_meets("__true", props) | _meets("__named", _identifiers(props)), "satisfied").when(undecided, "unknown").otherwise("violated")
    elif rule.check == "property_equals":
        held = F.exists("__got", lambda g: (g["path"] == props[0]) & (g["value"] == rule.values[0].lower()))
        state = F.when(undecided, "unknown").when(held, "satisfied").otherwise("violated")
    elif rule.check == "property_absent_or_false":
        state = F.when(_meets("__true", props), "violated").when(undecided, "unknown").otherwise("satisfied")
    elif rule.check == "property_not_in":
        bad = F.exists("__got", lambda g: g["path"].isin(*props) & _among(g["value"], [v.lower() for v in rule.values]))
        state = F.when(bad, "violated").when(undecided, "unknown").otherwise("satisfied")
    elif rule.check == "no_open_ingress":
        state = F.when(_open_ingress(), "violated").when(undecided, "unknown").otherwise("satisfied")
    elif rule.check in ("text_absent", "text_present"):
        state = F.when(_says(rule.values) == F.lit(rule.check == "text_present"), "satisfied").otherwise("violated")
    else:
        raise ValueError(f"unknown assertion {rule.check}")
    settled = _meets("__true", rule.unless_truthy) | _meets("__referenced", rule.unless_referenced_by) | _says(rule.unless_text_present)
    return F.when(settled, "satisfied").otherwise(state)


def _applies(rule: AssetRule) -> Column:
    on = F.col("kind").isin(*rule.kinds)
    for name, wanted in (("provider", rule.providers), ("native", rule.natives)):
        if wanted:
            on &= F.col(name).isin(*wanted)
    for name, refused in (("provider", rule.not_providers), ("native", rule.not_natives)):
        if refused:
            on &= ~F.col(name).isin(*refused)
    return F.coalesce(on, F.lit(False))


def evaluate(resources: DataFrame, rules: list[AssetRule] | None = None) -> DataFrame:
    """repo_id, address, rule_id, severity, outcome of every rule that applies to a resource.

    resources: repo_id, address, kind, native, provider, properties (JSON text), unknown (paths that a plan leaves open).
    Names and values are compared in lower case; numbers other than 0 and filled lists or objects are true. Properties that are
    null or no JSON are empty ones. Other resources that name an address are found by one join on it; a resource doesn't count for itself.
    """
    rules = RULES if rules is None else rules
    text = F.lower(F.coalesce("properties", F.lit("{}")))
    rows = resources.select("repo_id", "address", "kind", F.coalesce("native", F.lit("")).alias("native"), F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("{}"))).alias("__v"), F.coalesce(F.transform("unknown", lambda u: F.lower(u)), F.array().cast("array<string>")).alias("__unknown"))
    rows = rows.withColumn("__text", F.to_json("__v"))
    pointing = sorted({p.lower() for r in rules for p in r.unless_referenced_by})
    if pointing:
        named = F.array(*[F.struct(F.lit(p).alias("path"), F.coalesce(_at(p + ".ref"), _at(p)).alias("target")) for p in pointing])
        links = rows.select("repo_id", F.lower("address").alias("own"), F.explode(named).alias("l")).where("l.target is not null and l.target <> own")
        links = links.groupBy(F.col("repo_id").alias("__r"), F.col("l.target").alias("__a")).agg(F.collect_set("l.path").alias("__referenced"))
        rows = rows.join(links, F.col("repo_id").eqNullSafe(F.col("__r")) & (F.lower("address") == F.col("__a")), "left").withColumn("__referenced", F.coalesce("__referenced", F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("__referenced", F.array().cast("array<string>"))
    # every property that a rule names is read once a resource; rules then ask which of them hold
    paths = sorted({p.lower() for r in rules for p in (*r.properties, *r.unless_truthy)})
    got = F.expr("array(" + ", ".join(f"struct('{p}' AS path, try_variant_get(__v, '$.{p}', 'string') AS value)" for p in paths) + ")") if paths else F.array().cast("array<struct<path:string,value:string>>")
    rows = rows.withColumn("__block", _blocks()).withColumn("__got", F.filter(got, lambda g: g["value"].isNotNull()))
    named = F.expr(f"transform(filter(__got, g -> NOT array_contains({_texts(NOTHING)}, trim(g.value))), g -> g.path)")
    rows = rows.withColumn("__true", F.transform(F.filter("__got", lambda g: _truthy(g["value"])), lambda g: g["path"])).withColumn("__named", named)
    decided = F.array(*[F.when(_applies(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), outcome(r).alias("outcome"))) for r in rules])
    # an inner explode would have its condition, with every rule in it, computed once more below
    found = rows.select("repo_id", "address", F.explode_outer(decided).alias("d")).where("d is not null")
    return found.select("repo_id", "address", "d.rule_id", "d.severity", "d.outcome")
