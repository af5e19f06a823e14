"""Taint, rule, candidate and suppression queries over the driver's tables: events stand for ordered program records of a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import semantics
from corvane.operators import graph, joins, taint
from corvane.plans.registry import query, table

KINDS = {"signup": "source", "view": "sanitizer", "error": "kill", "click": "guard", "purchase": "sink"}
_TAINT = """marked AS (SELECT *, max(event_id) FILTER (event_type = 'signup') OVER w AS source, max(event_id) FILTER (event_type = 'error') OVER w AS kill, max(event_id) FILTER (event_type = 'view') OVER w AS clean
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tainted AS (SELECT event_id, user_id, source AS source_event_id, value FROM marked WHERE event_type = 'purchase' AND source IS NOT NULL AND source > coalesce(kill, -1) AND source > coalesce(clean, -1))"""


def _tainted(spark: SparkSession, sf: str) -> DataFrame:
    events, kind = table(spark, sf, "events").drop("props"), F.col("event_type")
    return taint.tainted_at_sinks(events, "user_id", ["ts", "event_id"], kind == "signup", kind == "error", kind == "view", kind == "purchase")


@query(f"WITH {_TAINT} SELECT t.event_id, t.user_id, t.source_event_id, 'SE1001' AS rule_id, 'high' AS severity FROM tainted t")
def taint_events(spark: SparkSession, sf: str) -> DataFrame:
    found = _tainted(spark, sf).select("event_id", "user_id", "source_event_id", F.lit("process-execution").alias("sink_kind"))
    return found.join(F.broadcast(semantics.rules(spark)), "sink_kind").select("event_id", "user_id", "source_event_id", "rule_id", "severity")


@query("SELECT event_id FROM events s WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events g WHERE g.event_type = 'click' AND g.user_id = s.user_id AND g.event_id <= s.event_id AND g.event_id + 100 >= s.event_id)")
def auth_unguarded_sinks(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    guards = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 100).alias("hi"))
    return joins.dominated(events.filter("event_type = 'purchase'"), guards, "user_id", "event_id", "lo", "hi", "left_anti").select("event_id")


_KIND_OF = [r[1] for r in semantics.RULES] + ["process-argument-execution"]


@query(f"""SELECT event_id, r.rule_id, r.policy, r.severity, r.cwe FROM (SELECT event_id, {str(_KIND_OF)}[CAST(event_id % {len(_KIND_OF)} AS INT) + 1] AS kind FROM events) e
LEFT JOIN (VALUES {', '.join(str(tuple(r)).replace('None', 'NULL') for r in semantics.RULES)}) r(rule_id, kind, policy, severity, cwe) ON e.kind = r.kind""")
def rule_join(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KIND_OF)), (F.col("event_id") % len(_KIND_OF) + 1).cast("int"))
    events = table(spark, sf, "events").select("event_id", kind.alias("sink_kind"))
    return events.join(F.broadcast(semantics.rules(spark)), "sink_kind", "left").select("event_id", "rule_id", "policy", "severity", "cwe")


@query("""SELECT rule, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY rule, user_id ORDER BY value DESC, event_id) AS n FROM (SELECT 'R' || (event_id % 3) AS rule, user_id, value, event_id FROM events WHERE event_type = 'purchase')) WHERE n = 1""")
def find_best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("R"), F.col("event_id") % 3).alias("rule"), "user_id", "value", "event_id")
    return graph.best_candidates(found, ["rule", "user_id"], [-F.col("value"), F.col("event_id")]).select("rule", "user_id", "event_id")


SUPPRESSIONS = [("SE1001", "u/8", 1, "accepted by review"), ("SE1002", "u/9", 1, "accepted by review"), ("SE9999", "u/8", 1, "accepted by review"), ("SE1001", "../u", 1, "accepted by review"), ("SE1001", "u/*", 1, "accepted by review"), ("SE1001", "u/7", 1, "short"), ("SE1001", "u/11", 0, "accepted by review")]
_FINDINGS = "f AS (SELECT 'SE1001' AS rule_id, 'u/' || user_id AS path, event_id % 2 AS start_byte, event_id AS finding FROM events WHERE event_type = 'purchase')"
_GIVEN = f"s AS (SELECT * FROM (VALUES {', '.join(map(str, SUPPRESSIONS))}) v(rule_id, path, start_byte, reason)), j AS (SELECT *, CASE WHEN rule_id NOT LIKE 'SE10__' OR rule_id > 'SE1010' THEN 'invalid-rule' WHEN path LIKE '%*%' OR path LIKE '../%' THEN 'invalid-scope' WHEN strlen(trim(reason)) < 8 THEN 'invalid-reason' END AS bad FROM s)"
_FIRST = "x AS (SELECT rule_id, path, start_byte, min(finding) AS finding FROM f JOIN (SELECT DISTINCT rule_id, path, start_byte FROM j WHERE bad IS NULL) USING (rule_id, path, start_byte) GROUP BY ALL)"


def _suppressed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    findings = table(spark, sf, "events").filter("event_type = 'purchase'").select(F.lit("SE1001").alias("rule_id"), F.concat(F.lit("u/"), "user_id").alias("path"), (F.col("event_id") % 2).alias("start_byte"), F.col("event_id").alias("finding"))
    given = spark.createDataFrame(SUPPRESSIONS, "rule_id string, path string, start_byte long, reason string")
    return joins.apply_suppressions(findings, given, ["rule_id", "path", "start_byte"], "finding", [r[0] for r in semantics.RULES])


@query(f"WITH {_FINDINGS}, {_GIVEN}, {_FIRST} SELECT * FROM f WHERE finding NOT IN (SELECT finding FROM x)")
def supp_apply(spark: SparkSession, sf: str) -> DataFrame:
    return _suppressed(spark, sf)[0].select("rule_id", "path", "start_byte", "finding")


@query(f"WITH {_FINDINGS}, {_GIVEN}, {_FIRST} SELECT j.rule_id, j.path, j.start_byte, j.reason, coalesce(bad, CASE WHEN x.finding IS NOT NULL THEN 'applied' ELSE 'stale' END) AS code FROM j LEFT JOIN x ON j.rule_id = x.rule_id AND j.path = x.path AND j.start_byte = x.start_byte")
def supp_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return _suppressed(spark, sf)[1].select("rule_id", "path", "start_byte", "reason", "code")
