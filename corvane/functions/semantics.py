"""What records mean: authorization kinds, sanitizer policies, identities, and the rules that sinks fall under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import compact

# Ordered word lists, policies, sinks and rules; the first list that matches decides.
AUTHORIZATION = {
    "tenant": ["tenant", "organization", "workspace"],
    "ownership": ["owner", "membership", "member"],
    "role": ["role", "permission", "scope", "capability"],
    "general": ["authoriz", "policy", "canaccess", "allowed", "enforce"],
    "authentication": ["authentic", "session", "login", "requireuser"],
}
POLICIES = {
    "command-control-data-separation": ["command", "shell"],
    "sql-control-data-separation": ["sql", "query", "parameter"],
    "filesystem-path-confinement": ["path", "file", "relative"],
    "redirect-destination-policy": ["redirect", "returnurl", "callback"],
    "outbound-destination-policy": ["url", "host", "origin"],
    "dynamic-code-control-data-separation": ["code", "expression"],
}
SOURCES = {
    "untrusted.form-data-value": ["formdata"],
    "sensitive.configuration-value": ["sensitiveconfiguration"],
    "untrusted.http-body-field": ["httpbody", "requestbody"],
    "untrusted.http-header-value": ["header"],
    "untrusted.http-cookie-value": ["cookie"],
    "untrusted.http-query-value": ["query", "requesturl"],
    "untrusted.server-action-parameter": ["serveraction"],
    "untrusted.environment-value": ["environment"],
}
SINKS = {
    "process-execution": "sink.process-execution", "process-argument-execution": "sink.process-execution", "database-access": "sink.database-query",
    "database-parameterized": "sink.database-query", "filesystem-operation": "sink.filesystem-operation", "network-request": "sink.outbound-request",
    "redirect": "sink.redirect", "dynamic-code-execution": "sink.dynamic-code-execution", "sensitive-mutation": "sink.sensitive-mutation",
    "cli-option-injection": "sink.cli-option-parser", "prototype-mutation": "sink.prototype-mutation", "sensitive-data-disclosure": "sink.sensitive-data-disclosure",
}
#: rule, sink kind, policy that clears it (none: nothing does), severity, weakness number (none: not in the taxonomy)
RULES = [
    ("SE1001", "process-execution", "command-control-data-separation", "high", 78),
    ("SE1002", "database-access", "sql-control-data-separation", "high", 89),
    ("SE1003", "filesystem-operation", "filesystem-path-confinement", "high", 22),
    ("SE1004", "network-request", "outbound-destination-policy", "high", 918),
    ("SE1005", "redirect", "redirect-destination-policy", "medium", 601),
    ("SE1006", "dynamic-code-execution", "dynamic-code-control-data-separation", "critical", 95),
    ("SE1007", "sensitive-mutation", None, "high", 862),
    ("SE1008", "cli-option-injection", "command-control-data-separation", "high", None),
    ("SE1009", "prototype-mutation", None, "high", None),
    ("SE1010", "sensitive-data-disclosure", None, "high", None),
]


def rules(spark: SparkSession) -> DataFrame:
    """Ten rows."""
    return spark.createDataFrame(RULES, "rule_id string, sink_kind string, policy string, severity string, cwe int")


def first_match(name: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    out, value = None, compact(name)
    for answer, words in table.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(value, F.lit(word))
        out = F.when(hit, answer) if out is None else out.when(hit, answer)
    return out.otherwise(default) if default else out


def authorization_kind(name: Column) -> Column:
    return F.coalesce(first_match(name, AUTHORIZATION), F.when(compact(name) == "auth", "authentication"))


def is_operation_authorization(name: Column) -> Column:
    return F.coalesce(authorization_kind(name) != "authentication", F.lit(False))


def sanitizer_policy(name: Column) -> Column:
    return first_match(name, POLICIES)


def source_identity(name: Column) -> Column:
    return first_match(name, SOURCES, "untrusted.request-value")


def sink_identity(kind: Column) -> Column:
    out = None
    for name, identity in SINKS.items():
        out = F.when(kind == name, identity) if out is None else out.when(kind == name, identity)
    return out.otherwise("sink.sensitive-operation")


def transformation_identity(kind: Column, name: Column) -> Column:
    value = compact(name)
    by_kind = F.when(kind == "argument", "argument").when(kind == "return", "return").when(kind == "call", "local-call").otherwise("value")
    by_name = F.when(kind == "alias", "alias").when(value.rlike("join$"), "path-base-join").when(value.rlike("(resolve|normalize)$"), "path-lexical-normalization").when(value.rlike("(realpath|canonicalize)$"), "path-canonicalization").when(value.rlike("relative$"), "path-relative").when(F.contains(value, F.lit("decode")), "decoding")
    return F.concat(F.lit("transformation."), F.coalesce(by_name, by_kind))


def semantic_role(kind: Column, name: Column) -> Column:
    transforms = kind.isin("assignment", "alias", "transformation", "argument", "return", "call")
    return F.when(kind.isin("source", "handler"), "untrusted-source").when(transforms, "transformation").when(kind == "guard", F.when(authorization_kind(name).isNotNull(), "authorization-check").otherwise("guard")).when(kind == "sanitizer", "sanitizer").when(kind == "sink", "sensitive-sink")


def semantic_identity(kind: Column, name: Column) -> Column:
    guard = F.coalesce(F.when(authorization_kind(name) == "authentication", "guard.authentication"), F.concat(F.lit("guard.authorization."), authorization_kind(name)), F.lit("guard.ambiguous"))
    cleaner = F.coalesce(F.concat(F.lit("sanitizer."), first_match(name, {"command": POLICIES["command-control-data-separation"], "sql": POLICIES["sql-control-data-separation"], "filesystem": POLICIES["filesystem-path-confinement"], "redirect-destination": POLICIES["redirect-destination-policy"], "outbound-destination": POLICIES["outbound-destination-policy"], "dynamic-code": POLICIES["dynamic-code-control-data-separation"]})), F.lit("sanitizer.unresolved"))
    return F.when(kind == "handler", "untrusted.handler-entry").when(kind == "source", source_identity(name)).when(kind == "guard", guard).when(kind == "sanitizer", cleaner).when(kind == "sink", sink_identity(name)).when(semantic_role(kind, name) == "transformation", transformation_identity(kind, name))


# What facts, records and relations become in the graph.
NODE_OF_FACT = {"function": "function", "method": "method", "module-import": "module-reference", "http-route-handler": "handler", "server-action-handler": "handler", "environment-access": "configuration", "guard-candidate": "guard", "call": "call"}
NODE_OF_RECORD = {
    "function": "function", "argument": "argument", "source": "source", "assignment": "assignment", "alias": "assignment", "transformation": "transformation", "call": "call",
    "sanitizer": "sanitizer", "guard": "guard", "return": "return", "sink": "sink", "handler": "handler",
}
EDGE_OF_RELATION = {"imports": "imports", "calls": "calls", "handles": "containment", "handler": "calls"}


def _looked_up(key: Column, table: dict, default: str | None = None) -> Column:
    return F.coalesce(*[F.when(key == k, v) for k, v in table.items()], F.lit(default))


def node_of_fact(kind: Column) -> Column:
    return _looked_up(kind, NODE_OF_FACT, "syntax-fact")


def node_of_record(kind: Column) -> Column:
    """Null for the kinds that have no node."""
    return _looked_up(kind, NODE_OF_RECORD)


def edge_of_relation(kind: Column) -> Column:
    return _looked_up(kind, EDGE_OF_RELATION, "containment")
