"""Queries of bindings, lineage, summaries, steps, contracts, caps and orders over the driver's tables.

Events stand for a program's records: a user is a function, the event's number its place, its type what it does. Conversations stand for
calls with arguments, lines for links between functions, pages for files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import evidence, findings, joins, modules, windows
from corvane.plans.registry import query, table


def _events(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return rows.filter(F.col("event_type").isin(*kinds)) if kinds else rows


# Joins


_PAGE_FILE = "'src/' || (page_id % 5) || '/m' || page_id || CASE WHEN page_id % 7 = 0 THEN '/index.ts' WHEN page_id % 3 = 0 THEN '.tsx' ELSE '.js' END"


@query(f"""WITH f AS (SELECT page_id, page_id % 2 AS repository, {_PAGE_FILE} AS path FROM pages),
i AS (SELECT page_id, page_id + CASE page_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 2 END AS wanted, page_id % 4 AS way FROM pages)
SELECT CAST(a.repository AS VARCHAR) AS repository, a.path, b.path AS module_path FROM i JOIN f a USING (page_id) JOIN f b ON b.page_id = i.wanted WHERE way < 3 AND a.page_id % 7 <> 0""")
def join_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Each file names another: beside it, in another folder, behind a root prefix, or out of the repository."""
    n, way = F.col("page_id"), F.col("page_id") % 4

    def stem(number) -> Column:
        return F.concat((number % 5).cast("string"), F.lit("/m"), number.cast("string"))

    end = F.when(n % 7 == 0, "/index.ts").when(n % 3 == 0, ".tsx").otherwise(".js")
    files = table(spark, sf, "pages").select("page_id", (n % 2).cast("string").alias("repository"), F.concat(F.lit("src/"), stem(n), end).alias("path"))
    module = F.when(way == 0, F.concat(F.lit("./m"), (n + 10).cast("string"))).when(way == 1, F.concat(F.lit("../"), stem(n + 4), F.lit(".ts"))).when(way == 2, F.concat(F.lit("@/"), stem(n + 8))).otherwise(F.concat(F.lit("../../../m"), (n + 2).cast("string")))
    imports = files.filter(n % 7 != 0).select("repository", "path", module.alias("module"))
    return modules.resolved(imports, files.select("repository", "path")).select("repository", "path", "module_path")


PARAMETERS = [(0, 0, None, "a"), (0, 1, "user", "u"), (0, 1, "assistant", "b"), (1, 0, None, "whole"), (1, 1, None, "rest"), (2, 0, "user", "only"), (2, 2, None, "c")]
_P = f"(VALUES {', '.join(str(p).replace('None', 'NULL') for p in PARAMETERS)}) p(target, slot, taken, name)"


@query(f"""WITH g AS (SELECT conv_id AS call_id, conv_id % 3 AS target, turn % 3 AS slot, CASE WHEN turn % 2 = 0 THEN role END AS given, 'v' || turn AS value FROM conversations),
j AS (SELECT * FROM g JOIN {_P} ON g.target = p.target AND g.slot = p.slot WHERE given IS NULL OR taken IS NULL OR given = taken)
SELECT DISTINCT call_id, CASE WHEN given IS NOT NULL AND taken IS NULL THEN name || '.' || given ELSE name END AS name, CASE WHEN given IS NULL AND taken IS NOT NULL THEN value || '.' || taken ELSE value END AS value FROM j""")
def join_argument_parameter(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    given = table(spark, sf, "conversations").select(F.col("conv_id").alias("call_id"), (F.col("conv_id") % 3).cast("int").alias("target"), (turn % 3).cast("int").alias("slot"), F.when(turn % 2 == 0, F.col("role")).alias("property"), F.concat(F.lit("v"), turn).alias("value"))
    return evidence.bind_arguments(given, spark.createDataFrame(PARAMETERS, "target int, slot int, property string, name string"))


NEEDS = [(0, "role", None), (1, "tenant", 0), (2, "owner", 0), (2, "owner", 1)]
_N = f"(VALUES {', '.join(str(n).replace('None', 'NULL') for n in NEEDS)}) n(target, policy, slot)"


@query(f"""WITH c AS (SELECT DISTINCT conv_id, conv_id % 3 AS target FROM conversations)
SELECT c.conv_id AS call_id, policy FROM c JOIN {_N} USING (target) GROUP BY ALL HAVING bool_and(slot IS NULL OR EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = c.conv_id AND t.turn % 2 = slot AND t.role = 'user' AND length(t.text) > 40))""")
def join_summary_binding(spark: SparkSession, sf: str) -> DataFrame:
    """A turn's text is an argument; those of users of more than 40 characters are trusted values of the conversation."""
    turns = table(spark, sf, "conversations")
    calls = turns.select(F.col("conv_id").alias("call_id"), (F.col("conv_id") % 3).cast("int").alias("target"), F.col("conv_id").alias("caller")).distinct()
    arguments = turns.select(F.col("conv_id").alias("call_id"), (F.col("turn") % 2).cast("int").alias("slot"), F.xxhash64("turn", "text").alias("value"))
    trusted = turns.filter("role = 'user' AND length(text) > 40").select(F.col("conv_id").alias("caller"), F.xxhash64("turn", "text").alias("value")).distinct()
    return evidence.satisfied_summaries(calls, arguments, spark.createDataFrame(NEEDS, "target int, policy string, slot int"), trusted)


_LINEAGE = """WITH RECURSIVE d AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events WHERE event_type IN ('view', 'click')),
u AS (SELECT e.event_id AS use, max(d.event_id) AS node FROM events e JOIN d ON d.user_id = e.user_id AND d.event_id < e.event_id WHERE e.event_type = 'purchase' GROUP BY e.event_id),
w AS (SELECT use, node, 0 AS hops FROM u UNION ALL SELECT w.use, d.parent, w.hops + 1 FROM w JOIN d ON d.event_id = w.node WHERE d.event_type = 'view' AND d.parent IS NOT NULL AND w.hops < 10)"""


@query(_LINEAGE + """
SELECT w.use, w.node AS origin, w.hops FROM w JOIN d ON d.event_id = w.node WHERE d.event_type = 'click'""")
def graph_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf)


def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    """A purchase is a gate that reads the value defined last; a view copies the one before it, a click is a call: which call, before it, a gate tests."""
    defined = _events(spark, sf, "view", "click")
    before = joins.as_of(defined, defined.select("user_id", "event_id", F.col("event_id").alias("parent")), "user_id", "event_id", ["parent"])
    parents = before.select(F.col("event_id").alias("node"), "parent", (F.col("event_type") == "click").alias("is_origin"))
    uses = joins.as_of(_events(spark, sf, "purchase"), defined.select("user_id", "event_id", F.col("event_id").alias("node")), "user_id", "event_id", ["node"])
    return evidence.origins(uses.filter("node IS NOT NULL").select(F.col("event_id").alias("use"), "node"), parents)


SUMMARIZED = [(0, "role", "enforced"), (1, "tenant", "boolean"), (2, "authentication", "enforced"), (3, "ownership", "boolean")]


@query(_LINEAGE + f""", o AS (SELECT w.use AS gate, w.node AS call_id FROM w JOIN d ON d.event_id = w.node WHERE d.event_type = 'click'), s AS (SELECT * FROM (VALUES {', '.join(map(str, SUMMARIZED))}) v(target, policy, mode) WHERE policy <> 'authentication'),
c AS (SELECT event_id AS call_id, policy, mode FROM events JOIN s ON s.target = event_id % 5 WHERE event_type = 'click')
SELECT call_id AS guard, policy FROM c WHERE mode = 'enforced' UNION SELECT gate, policy FROM c JOIN o USING (call_id) WHERE mode = 'boolean'""")
def auth_synthetic_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks call one of five functions, four of which are summarised."""
    calls = _events(spark, sf, "click").select(F.col("event_id").alias("call_id"), (F.col("event_id") % 5).cast("int").alias("target"))
    gates = _lineage(spark, sf).select(F.col("use").alias("gate"), F.col("origin").alias("call_id"))
    return evidence.synthetic_guards(calls, spark.createDataFrame(SUMMARIZED, "target int, policy string, mode string"), gates)


@query("""WITH RECURSIVE n AS (SELECT user_id, event_id AS name, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events),
s AS (SELECT * FROM n WHERE target IS NOT NULL AND name % 10 <> 0),
w AS (SELECT user_id, name, target, 1 AS hops FROM s UNION ALL SELECT w.user_id, w.name, s.target, w.hops + 1 FROM w JOIN s ON s.user_id = w.user_id AND s.name = w.target WHERE w.hops < 8)
SELECT user_id AS scope, name, arg_max(target, hops) AS target, CAST(max(hops) AS INT) AS hops FROM w GROUP BY ALL""")
def graph_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """An event is another name of the user's event before; every tenth has a second meaning, so it stands for itself."""
    events = _events(spark, sf)
    before = joins.as_of(events, events.select("user_id", "event_id", F.col("event_id").alias("target")), "user_id", "event_id", ["target"]).filter("target IS NOT NULL")
    names = before.select(F.col("user_id").alias("scope"), F.col("event_id").alias("name"), "target")
    return evidence.resolve_aliases(names.unionByName(names.filter("name % 10 = 0").withColumn("target", F.col("target") - 1)))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS caller, 's' || l_suppkey AS callee FROM lineitem WHERE l_returnflag = 'A' UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R'),
w(function, round) AS (SELECT 's' || s_suppkey, 0 FROM supplier WHERE s_acctbal < 500 UNION SELECT e.caller, w.round + 1 FROM w JOIN e ON w.function = e.callee WHERE w.round < 4)
SELECT function, CAST(min(round) AS INT) AS round FROM w GROUP BY function""")
def auth_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with little on their account check; a returned line calls from its part, a refused one from its supplier."""
    line, part, supplier = table(spark, sf, "lineitem"), F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    calls = line.filter("l_returnflag = 'A'").select(part.alias("caller"), supplier.alias("callee")).unionByName(line.filter("l_returnflag = 'R'").select(supplier.alias("caller"), part.alias("callee")))
    checks = table(spark, sf, "supplier").filter("s_acctbal < 500").select(F.concat(F.lit("s"), "s_suppkey").alias("function"))
    return evidence.summaries(checks, calls, 4)


_GUARD = "SELECT user_id AS resource, event_id % 3 AS principal, min(event_id) AS since FROM events WHERE event_type = '{}' GROUP BY ALL"


@query(f"""WITH t AS ({_GUARD.format('click')}), o AS ({_GUARD.format('view')}), p AS (SELECT t.resource, t.principal, greatest(t.since, o.since) AS since FROM t JOIN o USING (resource, principal))
SELECT e.event_id AS sink, coalesce(p.since < e.event_id, false) AS authorized FROM events e LEFT JOIN p ON p.resource = e.user_id AND p.principal = e.event_id % 3 WHERE event_type = 'purchase'""")
def auth_resource_bound(spark: SparkSession, sf: str) -> DataFrame:
    """A click checks the tenant of a user's record, a view its owner, both for one of three principals; purchases change it."""
    rows = _events(spark, sf).select("event_id", "event_type", F.col("user_id").alias("resource"), (F.col("event_id") % 3).alias("principal"), F.col("event_id").alias("at"))
    pairs = evidence.resource_pairs(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"))
    sinks = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("sink"), "resource", "principal", "at")
    return evidence.bound_sinks(sinks, pairs).select("sink", "authorized")


@query("""WITH i AS (SELECT event_id // 20 AS file, CASE WHEN count(DISTINCT event_id % 4 // 2) = 1 THEN min(event_id % 4 // 2) END AS module FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id AS call_id FROM events e JOIN i ON i.file = e.event_id // 20 WHERE event_type = 'purchase' AND i.module = 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.event_id // 20 = i.file AND b.event_id % 9 = 0)""")
def join_trusted_composer(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty events are a file. A sign-up imports one of two modules into it, the first of them trusted; each ninth event, if an error, binds the name anew."""
    rows = _events(spark, sf).select("event_id", "event_type", F.floor(F.col("event_id") / 20).alias("file"), F.lit("path").alias("root"))
    imports = rows.filter("event_type = 'signup'").select("file", "root", F.concat(F.lit("m"), F.floor(F.col("event_id") % 4 / 2)).alias("module"))
    bindings = rows.filter("event_type = 'error' AND event_id % 9 = 0").select("file", "root")
    calls = rows.filter("event_type = 'purchase'").select(F.col("event_id").alias("call_id"), "file", "root")
    return evidence.trusted_callees(calls, imports, bindings, ["m0"]).select("call_id")


VALUES, OUTPUTS = ["a", "a.b", "c", "d[0]"], ["a", "a.b.c", "d", "e", "ab"]


@query(f"""WITH s AS (SELECT event_id, user_id, event_id - 200 AS lo, event_id + 400 AS hi, {VALUES}[CAST(event_id % 4 AS INT) + 1] AS v FROM events WHERE event_type = 'view'),
d AS (SELECT event_id AS at, user_id, {OUTPUTS}[CAST(event_id % 5 AS INT) + 1] AS o, CASE WHEN event_id % 5 = 3 THEN 'c' END AS r FROM events WHERE event_type = 'error')
SELECT event_id FROM s WHERE EXISTS (SELECT 1 FROM d WHERE d.user_id = s.user_id AND d.at > s.lo AND d.at < s.hi AND (o = v OR starts_with(o, v || '.') OR starts_with(o, v || '[') OR starts_with(v, o || '.') OR starts_with(v, o || '[') OR coalesce(r = v, false)))""")
def join_redefined_names(spark: SparkSession, sf: str) -> DataFrame:
    """An error defines one of five names, or calls a method of `c`; a view needs that one of four values stays as it is around it."""
    def pick(words: list[str]):
        return F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % len(words) + 1).cast("int"))

    own = F.col("event_id")
    ranges = _events(spark, sf, "view").select("event_id", "user_id", (own - 200).alias("lo"), (own + 400).alias("hi"), pick(VALUES).alias("v"))
    made = _events(spark, sf, "error").select("user_id", own.alias("at"), pick(OUTPUTS).alias("o"), F.when(own % 5 == 3, "c").alias("r"))
    return joins.redefined_between(ranges, made, "user_id", "lo", "hi", "at", "v", "o", "r").select("event_id")


@query("""WITH f AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS fingerprint FROM events WHERE event_type = 'purchase'),
a AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN sha256('other') ELSE fingerprint END AS seen, CASE WHEN event_id % 2 = 0 THEN 'supported' ELSE 'rejected' END AS verdict FROM f WHERE event_id % 3 <> 0)
SELECT f.event_id AS finding_id, CASE WHEN a.seen IS NULL THEN NULL WHEN a.seen = f.fingerprint THEN a.verdict ELSE 'mismatch' END AS verdict,
CASE WHEN a.seen = f.fingerprint THEN '{"assessment":{"verdict":"' || a.verdict || '"}}' ELSE '{}' END AS properties FROM f LEFT JOIN a USING (event_id)""")
def assess_join(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("event_id")
    rows = _events(spark, sf, "purchase").select(own.alias("finding_id"), F.sha2(own.cast("string"), 256).alias("fingerprint"))
    seen = F.when(F.col("finding_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("fingerprint"))
    given = rows.filter("finding_id % 3 <> 0").select("finding_id", seen.alias("fingerprint"), F.when(F.col("finding_id") % 2 == 0, "supported").otherwise("rejected").alias("verdict"))
    return findings.attach_assessments(rows, given).select("finding_id", "verdict", findings.assessment_property(F.col("verdict")).alias("properties"))


# Windows, caps and orders


@query("SELECT p.event_id, (SELECT count(*) FROM events d WHERE d.event_type = 'click' AND d.user_id = p.user_id AND d.event_id < p.event_id) AS definitions FROM events p WHERE p.event_type = 'purchase'")
def win_definition_count(spark: SparkSession, sf: str) -> DataFrame:
    return windows.definitions_before(_events(spark, sf, "purchase"), _events(spark, sf, "click"), ["user_id"], "event_id").select("event_id", "definitions")


@query("""SELECT event_id FROM (SELECT event_id, user_id, event_type, lag(user_id) OVER w AS u, lag(event_type) OVER w AS t FROM events WINDOW w AS (ORDER BY user_id, event_id)) WHERE coalesce(u <> user_id, true) AND coalesce(t <> event_type, true)""")
def win_adjacent_either(spark: SparkSession, sf: str) -> DataFrame:
    """Of neighbours that share a user or a type, the second goes."""
    return windows.adjacent_distinct(_events(spark, sf).select("user_id", "event_id", "event_type"), ["user_id", "event_id"], ["user_id", "event_type"]).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS before FROM events) WHERE before >= value")
def base_order_check(spark: SparkSession, sf: str) -> DataFrame:
    return windows.out_of_order(_events(spark, sf).select("event_id", "value"), ["event_id"], "value").select("event_id")


@query("SELECT page_id, url, reason FROM (SELECT page_id, url, CASE WHEN strlen(html) > 4000 THEN 'too-large' WHEN page_id % 3 = 0 THEN 'vendor' WHEN page_id % 3 = 1 THEN 'hidden' END AS reason FROM pages) WHERE reason IS NOT NULL ORDER BY url, page_id LIMIT 64")
def sel_skip_list(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.octet_length("html") > 4000, "too-large").when(F.col("page_id") % 3 == 0, "vendor").when(F.col("page_id") % 3 == 1, "hidden")
    return table(spark, sf, "pages").select("page_id", "url", reason.alias("reason")).filter("reason IS NOT NULL").orderBy("url", "page_id").limit(64)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 2 ORDER BY user_id, event_id LIMIT 300")
def sel_diagnostics_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Errors as diagnostics of a user's file: two a file, 300 in all."""
    return windows.capped(_events(spark, sf, "error").select("user_id", "event_id"), "user_id", ["event_id"], 2, 300)


@query("""SELECT user_id, event_id, NULL AS code FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 65 ORDER BY user_id, event_id LIMIT 9000""".join(["SELECT * FROM (", ") UNION ALL SELECT user_id, NULL, 'fact-limit-reached' FROM events GROUP BY user_id HAVING count(*) > 65"]))
def sel_facts_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts of a user's file: 65 a file and 9000 in all, and who had more."""
    kept, cut_off = windows.bounded_facts(_events(spark, sf).select("user_id", "event_id"), "user_id", ["event_id"], 65, 9000)
    return kept.select("user_id", "event_id", F.lit(None).cast("string").alias("code")).unionByName(cut_off.select("user_id", F.lit(None).cast("long").alias("event_id"), "code"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS n FROM events) WHERE n <= 4000")
def sel_record_cap(spark: SparkSession, sf: str) -> DataFrame:
    """A budget of records that all files share, in the order of files."""
    rows = _events(spark, sf).select("user_id", "event_id")
    return windows.running_total(rows, ["user_id", "event_id"], F.lit(1), "n").filter("n <= 4000").select("event_id")


@query("""WITH n AS (SELECT 'c' || c_custkey AS node_id, c_custkey AS ordinal FROM customer UNION ALL SELECT 'n' || n_nationkey, n_nationkey - 100 FROM nation), k AS (SELECT * FROM n ORDER BY ordinal LIMIT 700),
e AS (SELECT 'n' || c_nationkey AS a, 'c' || c_custkey AS b, c_custkey AS ordinal FROM customer), l AS (SELECT * FROM e WHERE a IN (SELECT node_id FROM k) AND b IN (SELECT node_id FROM k) ORDER BY ordinal LIMIT 500)
SELECT 'node' AS part, node_id AS id FROM k UNION ALL SELECT 'edge', a || '>' || b FROM l UNION ALL SELECT 'truncated', CAST((SELECT count(*) FROM n) > 700 OR (SELECT count(*) FROM e) > (SELECT count(*) FROM l) AS VARCHAR)""")
def graph_capped(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    c, n = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    nodes = customer.select(c.alias("node_id"), F.col("c_custkey").alias("ordinal")).unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), (F.col("n_nationkey") - 100).cast("long").alias("ordinal")))
    kept, left, cut_off = evidence.capped_graph(nodes, customer.select(n.alias("from_node"), c.alias("to_node"), F.col("c_custkey").alias("ordinal")), 700, 500)
    return kept.select(F.lit("node").alias("part"), F.col("node_id").alias("id")).unionByName(left.select(F.lit("edge").alias("part"), F.concat_ws(">", "from_node", "to_node").alias("id"))).unionByName(cut_off.select(F.lit("truncated").alias("part"), F.col("truncated").cast("string").alias("id")))


@query("""WITH c AS (SELECT event_id % 3 AS rule, user_id AS sink, event_id AS arrival, value FROM events WHERE event_type = 'purchase'), f AS (SELECT rule, sink, min(arrival) AS first FROM c GROUP BY ALL),
l AS (SELECT CASE WHEN (SELECT count(*) FROM f) >= 90 THEN (SELECT max(first) FROM (SELECT first FROM f ORDER BY first LIMIT 90)) ELSE (SELECT max(arrival) FROM c) END AS last)
SELECT rule, sink, arrival FROM (SELECT *, row_number() OVER (PARTITION BY rule, sink ORDER BY value DESC, arrival) AS n FROM c WHERE arrival <= (SELECT last FROM l)) WHERE n = 1""")
def sel_candidate_budget(spark: SparkSession, sf: str) -> DataFrame:
    found = _events(spark, sf, "purchase").select((F.col("event_id") % 3).alias("rule"), F.col("user_id").alias("sink"), F.col("event_id").alias("arrival"), "value")
    return evidence.budgeted_candidates(found, ["rule", "sink"], "arrival", [-F.col("value"), F.col("arrival")], evidence.candidate_budget(30, 2, 1000)).select("rule", "sink", "arrival")


@query("""WITH f AS (SELECT event_id AS finding_id, CASE WHEN event_id % 4 <> 0 THEN md5(CAST(user_id AS VARCHAR)) END AS contract FROM events WHERE event_type = 'purchase')
SELECT finding_id, CAST(n AS INT) AS place, total > 100 AS truncated FROM (SELECT finding_id, row_number() OVER (ORDER BY contract NULLS FIRST, finding_id) AS n, count(*) OVER () AS total FROM f) WHERE n <= 100""")
def find_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in their stable order, those without a contract first, cut at a limit that the rows tell of."""
    rows = _events(spark, sf, "purchase").select(F.col("event_id").alias("finding_id"), F.when(F.col("event_id") % 4 != 0, F.md5(F.col("user_id").cast("string"))).alias("contract"))
    return findings.first_of(rows, [F.col("contract").asc_nulls_first(), F.col("finding_id")], 100).select("finding_id", "place", "truncated")


@query("""SELECT CASE WHEN total > 50 AND n = 50 THEN NULL ELSE event_id END AS event_id, CASE WHEN total > 50 AND n = 50 THEN 'error-limit-reached' ELSE event_type END AS code
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS n, count(*) OVER () AS total FROM events WHERE event_type = 'error') WHERE n <= 50""")
def sel_error_cap(spark: SparkSession, sf: str) -> DataFrame:
    errors = _events(spark, sf, "error").select("event_id", F.col("event_type").alias("code"))
    return windows.with_limit(errors, [F.col("event_id")], 50, {"code": "error-limit-reached"})


_SEVERITY = {"error": "critical", "purchase": "high", "click": "medium", "view": "low", "signup": "informational"}
_F = """f AS (SELECT event_id AS finding_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' WHEN 'view' THEN 'low' ELSE 'informational' END AS severity,
['high', 'medium', 'low'][CAST(event_id % 3 AS INT) + 1] AS confidence, 'R' || (event_id % 7) AS rule_id, 'u/' || user_id || '.ts' AS path, event_id % 5 AS sink_start, 'C' || (event_id % 4) AS category FROM events)"""


def _found(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("event_id")
    return _events(spark, sf).select(
        own.alias("finding_id"), text.mapped(F.col("event_type"), _SEVERITY).alias("severity"), F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), (own % 3 + 1).cast("int")).alias("confidence"),
        F.concat(F.lit("R"), own % 7).alias("rule_id"), F.concat(F.lit("u/"), "user_id", F.lit(".ts")).alias("path"), (own % 5).alias("sink_start"), F.concat(F.lit("C"), own % 4).alias("category"),
    )


_SORTS = {
    "severity": "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END", "confidence": "CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END",
    "rule": "rule_id", "file": "path, sink_start", "category": "category",
}


@query(f"WITH {_F} " + " UNION ALL ".join(f"SELECT '{name}' AS sort, finding_id, CAST(n AS INT) AS place FROM (SELECT finding_id, row_number() OVER (ORDER BY {by}, finding_id) AS n FROM f) WHERE n <= 40" for name, by in _SORTS.items()))
def find_sorts(spark: SparkSession, sf: str) -> DataFrame:
    """The head of the findings in each of the five orders."""
    rows, out = _found(spark, sf), None
    for name in _SORTS:
        head = findings.first_of(rows, findings.order_of(name), 40).select(F.lit(name).alias("sort"), "finding_id", "place")
        out = head if out is None else out.unionByName(head)
    return out


@query(f"WITH {_F} SELECT finding_id FROM f WHERE contains(lower(path), 'u/1') AND contains(lower(severity), 'hi') AND (contains(CAST(finding_id AS VARCHAR), '7') OR contains(lower(rule_id), '7') OR contains(severity, '7') OR contains(path, '7') OR contains(category, '7') OR contains(confidence, '7'))")
def find_filter(spark: SparkSession, sf: str) -> DataFrame:
    return findings.matching(_found(spark, sf), "7", path="U/1", severity="hi").select("finding_id")


@query(f"WITH {_F} SELECT * FROM f WHERE finding_id = 77")
def find_explain(spark: SparkSession, sf: str) -> DataFrame:
    return findings.explain(_found(spark, sf), 77)


# Steps, contracts, aggregates


_TRAIL = """t AS (SELECT event_id AS finding_id, [event_id - 3, event_id - 2, event_id - 1, event_id] AS trail FROM events WHERE event_type = 'purchase')"""


def _trails(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("event_id")
    return _events(spark, sf, "purchase").select(own.alias("finding_id"), F.array(own - 3, own - 2, own - 1, own).alias("trail"))


def _hash(prefix: str, *parts: str) -> str:
    fields = " || ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || {p}, '-')" for p in parts)
    return f"'{prefix}' || left(sha256({fields}), 24)"


_STEPS = f"""s AS (SELECT finding_id, ordinal, trail[ordinal + 1] AS record, CASE WHEN ordinal > 0 THEN trail[ordinal] END AS before FROM t, (SELECT unnest([0, 1, 2, 3]) AS ordinal))"""


@query(f"WITH {_TRAIL}, {_STEPS} SELECT finding_id, CAST(ordinal AS INT) AS ordinal, record, CASE WHEN before IS NOT NULL THEN {_hash('ge_', chr(39) + 'step' + chr(39), 'before', 'record')} END AS previous_edge, e.event_type, e.user_id FROM s LEFT JOIN events e ON e.event_id = s.record")
def find_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A purchase's trail is the three events before it and itself."""
    records = _events(spark, sf).select(F.col("event_id").alias("record"), "event_type", "user_id")
    return evidence.trail_steps(_trails(spark, sf), records, record="record").select("finding_id", "ordinal", "record", "previous_edge", "event_type", "user_id")


_ROLE = {"signup": "untrusted-source", "view": "transformation", "click": "transformation", "error": "sanitizer", "purchase": "sensitive-sink"}
TAXONOMY = [("R0", "1", "injection", "separation"), ("R1", "1", "access", "authorization"), ("SE1007", "1", "access", "ownership")]


@query(f"""WITH {_TRAIL}, {_STEPS}, r AS (SELECT finding_id, ordinal, ['R0', 'R1', 'SE1007', 'none'][CAST(finding_id % 4 AS INT) + 1] AS rule_id, CASE WHEN ordinal = 0 THEN 'signup' WHEN ordinal = 3 THEN 'purchase' ELSE e.event_type END AS type, CAST(record // 2 AS VARCHAR) AS path, e.user_id AS a FROM s JOIN events e ON e.event_id = s.record),
c AS (SELECT *, type IN ('view', 'click') AS loose, CASE type WHEN 'signup' THEN 'source/preserves-influence' WHEN 'error' THEN 'sanitizer/restricts-value' WHEN 'purchase' THEN 'sink/preserves-influence' WHEN 'view' THEN 'propagation/preserves-influence' ELSE 'propagation/uncertain' END AS shown,
  CASE WHEN type = 'signup' THEN CASE WHEN rule_id = 'SE1007' THEN 'protected-resource-id' ELSE 'http-body-field' END ELSE '-' END AS source_kind, CASE WHEN type = 'purchase' THEN 'redirect-response' ELSE '-' END AS sink_kind, split_part(CASE type WHEN 'signup' THEN 'source/' WHEN 'error' THEN 'sanitizer/' WHEN 'purchase' THEN 'sink/' ELSE 'propagation/' END, '/', 1) AS role FROM r WHERE type IS NOT NULL),
k AS (SELECT *, lag(role || '|' || path || '|' || a) OVER (PARTITION BY finding_id ORDER BY ordinal) AS before FROM c),
p AS (SELECT finding_id, rule_id, count(*) AS steps, bool_or(shown = 'propagation/uncertain') AS uncertain, string_agg(shown || '/' || source_kind || '/' || sink_kind, '>' ORDER BY ordinal) AS meaning, string_agg(path || '/' || a || '/' || (a + 1), '>' ORDER BY ordinal) AS places, arg_min(role, ordinal) AS first, arg_max(role, ordinal) AS last
  FROM k WHERE NOT (loose AND coalesce(before = role || '|' || path || '|' || a, false)) GROUP BY ALL),
f AS (SELECT finding_id, steps, uncertain, places, sha256(version || '|' || category || '|' || invariant || '|' || uncertain || '|' || meaning) AS fingerprint FROM p JOIN (VALUES {', '.join(map(str, TAXONOMY))}) x(rule_id, version, category, invariant) USING (rule_id) WHERE first = 'source' AND last = 'sink')
SELECT finding_id, CAST(steps AS INT) AS steps, uncertain, fingerprint, sha256(fingerprint || '|' || places) AS duplicate_fingerprint FROM f""")
def find_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """The trails' steps by what the events do; clicks are not proven. Neighbours of one half number are one place."""
    records = _events(spark, sf).select(F.col("event_id").alias("record"), "event_type", "user_id")
    steps = evidence.trail_steps(_trails(spark, sf), records, record="record").filter("event_type IS NOT NULL")
    kind = F.when(F.col("ordinal") == 0, "signup").when(F.col("ordinal") == 3, "purchase").otherwise(F.col("event_type"))
    rule = F.element_at(F.array(*map(F.lit, ["R0", "R1", "SE1007", "none"])), (F.col("finding_id") % 4 + 1).cast("int"))
    meant = steps.select(
        "finding_id", "ordinal", rule.alias("rule_id"), text.mapped(kind, _ROLE).alias("role"), F.when(kind != "click", "proven").alias("certainty"), F.when(kind == "purchase", "sink.redirect").when(kind == "signup", "untrusted.http-header-value").alias("identity"),
        F.floor(F.col("record") / 2).cast("string").alias("path"), F.col("user_id").alias("start"), (F.col("user_id") + 1).alias("end"),
    )
    return evidence.contracts(evidence.contract_steps(meant), spark.createDataFrame(TAXONOMY, "rule_id string, version string, category string, invariant string"))


@query("""WITH p AS (SELECT user_id, event_id, event_type, ts, lead(event_id) OVER w AS to_node, lead(ts) OVER w AS to_ts, lead(event_type) OVER w AS to_type, lead(event_id, 2) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, event_id % 11 <> 0 AND (event_type = 'click' OR user_id % 2 = 0 OR to_ts >= ts OR event_type = 'error') AND third IS NOT NULL AS realizable FROM p WHERE to_node IS NOT NULL""")
def graph_realizable(spark: SparkSession, sf: str) -> DataFrame:
    """Trails of two events of a user by number; one edge, which is missing where the user has no further event, and leads elsewhere for each eleventh."""
    events = _events(spark, sf)
    w = Window.partitionBy("user_id").orderBy("event_id")
    two = events.withColumns({"to_node": F.lead("event_id").over(w), "to_ts": F.lead("ts").over(w), "third": F.lead("event_id", 2).over(w)}).filter("to_node IS NOT NULL")
    start = F.when(F.col("event_id") % 11 == 0, F.col("event_id") - 1).otherwise(F.col("event_id"))
    kind = F.when(F.col("event_type") == "click", "calls").otherwise("assignment")
    edge = F.struct(start.alias("from_node"), "to_node", kind.alias("kind"), (F.col("user_id") % 2 != 0).alias("same_file"), F.col("ts").alias("from_at"), F.col("to_ts").alias("to_at"), (F.col("event_type") == "error").alias("inside"))
    edges = F.when(F.col("third").isNotNull(), F.array(edge)).otherwise(F.slice(F.array(edge), F.lit(1), F.lit(0)))
    return two.select("event_id", evidence.realizable(F.array("event_id", "to_node"), edges).alias("realizable"))


@query("""WITH e AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id)
SELECT user_id AS function, array_to_string(list_sort(list_distinct(list('P' || (event_id % 3)))), ',') AS policies FROM events JOIN e USING (user_id) WHERE event_type = 'click' AND event_id + 1500 >= last GROUP BY user_id""")
def agg_helper_policies(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    guards = events.filter("event_type = 'click'").select(F.col("user_id").alias("function"), F.concat(F.lit("P"), F.col("event_id") % 3).alias("policy"), (F.col("event_id") + 1500).alias("dominance_end"))
    ends = events.groupBy(F.col("user_id").alias("function")).agg(F.max("event_id").alias("end"))
    return evidence.helper_policies(guards, ends).select("function", F.array_join("policies", ",").alias("policies"))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER w AS INT) - 1 AS ordinal, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def agg_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's turns as a function's parameters in order: rows with their place, never one value."""
    own = Window.partitionBy("conv_id")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return turns.withColumns({"ordinal": (F.row_number().over(own.orderBy("turn")) - 1).cast("int"), "n": F.count("*").over(own)})


@query("SELECT count(*) AS records, count(DISTINCT user_id) AS functions, count(*) FILTER (event_type = 'signup') AS sources, count(*) FILTER (event_type = 'view') AS sanitizers, count(*) FILTER (event_type = 'click') AS guards, count(*) FILTER (event_type = 'purchase') AS sinks, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS functions_with_sinks FROM events")
def agg_analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, sf).agg(
        F.count("*").alias("records"), F.countDistinct("user_id").alias("functions"), F.count_if(kind == "signup").alias("sources"), F.count_if(kind == "view").alias("sanitizers"),
        F.count_if(kind == "click").alias("guards"), F.count_if(kind == "purchase").alias("sinks"), F.countDistinct(F.when(kind == "purchase", F.col("user_id"))).alias("functions_with_sinks"),
    )


@query("""SELECT CAST(f AS VARCHAR) AS caller, CAST(t AS VARCHAR) AS callee, 'control-flow' AS kind FROM (SELECT lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, event_id AS t FROM events) WHERE f IS NOT NULL
UNION ALL SELECT CAST(e.event_id AS VARCHAR), 'f' || c.c_custkey, 'calls' FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'click'""")
def graph_control_and_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Each event after the one before it, and each click as a call of the customer of its user's number."""
    events = _events(spark, sf)
    control = windows.previous_edges(events, "user_id", ["ts", "event_id"], "event_id").select(F.col("from_node").cast("string").alias("caller"), F.col("to_node").cast("string").alias("callee"), F.lit("control-flow").alias("kind"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    calls = events.filter("event_type = 'click'").join(known, "user_id").select(F.col("event_id").cast("string").alias("caller"), F.concat(F.lit("f"), "user_id").alias("callee"), F.lit("calls").alias("kind"))
    return control.unionByName(calls)
