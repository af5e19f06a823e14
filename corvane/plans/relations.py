"""Join, window and graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from corvane.operators import graph, joins, lines, windows
from corvane.plans.registry import query, table


#: Events whose user 7 is unknown, and which have a value in two rows of three: nulls in a key and beside it.
_EVENTS = "(SELECT event_id, ts, NULLIF(user_id, 7) AS user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"


def _gappy(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.withColumns({"user_id": F.nullif("user_id", F.lit(7)), "value": F.when(F.col("event_id") % 3 != 0, F.col("value"))})


@query(f"""SELECT p.event_id, p.value, c.event_id AS click_id FROM (SELECT * FROM {_EVENTS} WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM {_EVENTS} WHERE event_type = 'click') c ON p.user_id = c.user_id AND c.ts < p.ts""")
def join_asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _latest_click(spark, sf, hot=None)


@query(f"""SELECT p.event_id, p.value, c.event_id AS click_id FROM (SELECT * FROM {_EVENTS} WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM {_EVENTS} WHERE event_type = 'click') c ON p.user_id = c.user_id AND c.ts < p.ts""")
def join_asof_sliced(spark: SparkSession, sf: str) -> DataFrame:
    """The same by slices of the order, for keys too large for a task."""
    return _latest_click(spark, sf, hot=True)


def _latest_click(spark: SparkSession, sf: str, hot: bool | None) -> DataFrame:
    events = _gappy(spark, sf)
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return joins.as_of(events.filter("event_type = 'purchase'"), clicks, "user_id", "ts", ["click_id"], hot=hot).select("event_id", "value", "click_id")


_SPANS = f"(SELECT user_id, event_id AS span_id, event_id - 40 AS lo, event_id + CAST(event_id % 97 AS BIGINT) * 5 AS hi FROM {_EVENTS} WHERE event_type = 'view')"


@query(f"""SELECT s.event_id, s.value, arg_min(v.span_id, (v.hi - v.lo, v.lo, v.span_id)) AS span_id FROM (SELECT * FROM {_EVENTS} WHERE event_type = 'purchase') s LEFT JOIN {_SPANS} v ON s.user_id = v.user_id AND s.event_id BETWEEN v.lo AND v.hi GROUP BY s.event_id, s.value""")
def join_interval_innermost(spark: SparkSession, sf: str) -> DataFrame:
    events = _gappy(spark, sf)
    return joins.innermost(events.filter("event_type = 'purchase'").drop("event_type"), _spans(events), "user_id", "event_id", "lo", "hi", "span_id").select("event_id", "value", "span_id")


def _spans(events: DataFrame) -> DataFrame:
    own = F.col("event_id")
    return events.filter("event_type = 'view'").select("user_id", own.alias("span_id"), (own - 40).alias("lo"), (own + own % 97 * 5).alias("hi"))


@query(f"SELECT s.event_id, s.user_id FROM {_EVENTS} s WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM {_SPANS} v WHERE v.user_id = s.user_id AND s.event_id BETWEEN v.lo AND v.hi)")
def join_dominating(spark: SparkSession, sf: str) -> DataFrame:
    events = _gappy(spark, sf)
    return joins.dominated(events.filter("event_type = 'purchase'"), _spans(events), "user_id", "event_id", "lo", "hi").select("event_id", "user_id")


@query(f"SELECT span_id FROM {_SPANS} v WHERE EXISTS (SELECT 1 FROM {_EVENTS} d WHERE d.event_type = 'error' AND d.user_id = v.user_id AND d.event_id > v.lo AND d.event_id < v.hi)")
def join_redefined_between(spark: SparkSession, sf: str) -> DataFrame:
    events = _gappy(spark, sf)
    return joins.redefined_between(_spans(events), events.filter("event_type = 'error'"), "user_id", "lo", "hi", "event_id").select("span_id")


@query("""WITH t AS (SELECT p_partkey AS part_id, p_type || '/' || p_size AS name, CAST(p_partkey % 5 AS BIGINT) AS scope FROM part),
c AS (SELECT o_orderkey AS call_id, p_type || '/' || (p_size + o_orderkey % 2) AS name, CAST(o_custkey % 5 AS BIGINT) AS scope FROM orders JOIN part ON p_partkey = o_orderkey),
o AS (SELECT name, scope, count(*) AS n, min(part_id) AS part_id FROM t GROUP BY ALL), a AS (SELECT name, count(*) AS n, min(part_id) AS part_id FROM t GROUP BY ALL)
SELECT c.call_id, CASE WHEN o.n = 1 THEN 'own' WHEN o.n IS NULL AND a.n = 1 THEN 'anywhere' ELSE 'none' END AS tier, CASE WHEN o.n = 1 THEN o.part_id WHEN o.n IS NULL AND a.n = 1 THEN a.part_id END AS part_id
FROM c LEFT JOIN o USING (name, scope) LEFT JOIN a USING (name)""")
def join_unique_match(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as functions: the calls are orders that ask for a part's type and size."""
    part, orders = table(spark, sf, "part").select("p_partkey", "p_type", "p_size"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    targets = part.select(F.col("p_partkey").alias("part_id"), F.concat_ws("/", "p_type", "p_size").alias("name"), (F.col("p_partkey") % 5).alias("scope"))
    calls = orders.join(part, F.col("o_orderkey") == F.col("p_partkey")).select(F.col("o_orderkey").alias("call_id"), F.concat_ws("/", "p_type", F.col("p_size") + F.col("o_orderkey") % 2).alias("name"), (F.col("o_custkey") % 5).alias("scope"))
    return joins.unique_match(calls, targets, "name", "scope", "part_id").select("call_id", "tier", "part_id")


@query("""WITH f AS (SELECT regexp_replace(url, '/[^/]*$', '') AS folder FROM pages), k AS (SELECT folder AS prefix FROM f GROUP BY folder HAVING count(*) > 1 UNION SELECT regexp_replace(folder, '/[^/]*$', '') FROM f)
SELECT p.page_id, arg_max(k.prefix, length(k.prefix)) AS prefix FROM (SELECT page_id, CASE WHEN page_id % 25 <> 0 THEN url END AS url FROM pages) p LEFT JOIN k ON p.url = k.prefix OR starts_with(p.url, k.prefix || '/') GROUP BY p.page_id""")
def join_longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Known: folders of several pages, and the folders above any."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    folder = pages.select(F.regexp_replace("url", "/[^/]*$", "").alias("prefix"))
    known = folder.groupBy("prefix").count().filter("count > 1").select("prefix").union(folder.select(F.regexp_replace("prefix", "/[^/]*$", "")))
    asked = pages.withColumn("url", F.when(F.col("page_id") % 25 != 0, F.col("url")))  # some have no address
    return joins.longest_prefix(asked, known, "url", "prefix").select("page_id", "prefix")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place FROM conversations)
SELECT u.conv_id, CAST(u.place AS INT) AS place, u.turn AS asked, a.turn AS answered FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.place = a.place WHERE u.role = 'user' AND a.role = 'assistant'""")
def join_positional(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    pairs = joins.positional(turns.filter("role = 'user'"), turns.filter("role = 'assistant'"), "conv_id", "turn")
    return pairs.select("conv_id", "place", F.col("left.turn").alias("asked"), F.col("right.turn").alias("answered"))


@query("SELECT event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'signup' AND b.user_id = e.user_id AND b.event_id < e.event_id)")
def join_unstable_target(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return joins.unstable(events.filter("event_type = 'purchase'"), events.filter("event_type = 'signup'"), "user_id", "event_id").select("event_id")


@query(f"SELECT * FROM (SELECT user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_node, event_id AS to_node FROM {_EVENTS} WHERE event_type <> 'signup') WHERE from_node IS NOT NULL AND user_id IS NOT NULL")
def win_control_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Sources have no place in the flow of control, nor have records outside functions."""
    kind = F.when(F.col("event_type") == "signup", "source").otherwise("call")
    events = _gappy(spark, sf).select("user_id", "ts", "event_id", kind.alias("kind"))
    return windows.previous_edges(windows.in_control_flow(events), "user_id", ["ts", "event_id"], "event_id")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations")
def win_segments(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return windows.segments(turns, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "segment")


def _hash(prefix: str, *parts: str) -> str:
    fields = " || ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || {p}, '-')" for p in parts)
    return f"'{prefix}' || left(sha256({fields}), 24)"


@query(f"""WITH n AS (SELECT 'region' AS kind, CAST(r_regionkey AS VARCHAR) AS name FROM region UNION SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation UNION SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer),
e AS (SELECT 'containment' AS kind, {_hash('gn_', "'region'", 'n_regionkey')} AS a, {_hash('gn_', "'nation'", 'n_nationkey')} AS b FROM nation UNION SELECT 'containment', {_hash('gn_', "'nation'", 'c_nationkey')}, {_hash('gn_', "'customer'", 'c_custkey')} FROM customer)
SELECT 'node' AS part, kind, {_hash('gn_', 'kind', 'name')} AS id FROM n UNION ALL SELECT 'edge', kind, {_hash('ge_', 'kind', 'a', 'b')} FROM e""")
def graph_build(spark: SparkSession, sf: str) -> DataFrame:
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    nodes = graph.union_distinct([graph.nodes_of(region, "region", "r_regionkey"), graph.nodes_of(nation, "nation", "n_nationkey"), graph.nodes_of(customer, "customer", "c_custkey")], "node_id")
    edges = graph.union_distinct([graph.edges_of(nation, "containment", ("region", "n_regionkey"), ("nation", "n_nationkey")), graph.edges_of(customer, "containment", ("nation", "c_nationkey"), ("customer", "c_custkey"))], "edge_id")
    return nodes.select(F.lit("node").alias("part"), "kind", F.col("node_id").alias("id")).unionByName(edges.select(F.lit("edge").alias("part"), "kind", F.col("edge_id").alias("id")))


def _supply_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every line links its part and its supplier, in both directions. Pairs of numbers are made distinct before they get names."""
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    ways = F.array(F.struct(part.alias("source"), supplier.alias("target")), F.struct(supplier.alias("source"), part.alias("target")))
    return pairs.select(F.explode(ways).alias("e")).select("e.*").withColumn("key", F.concat_ws(">", "source", "target"))


_SUPPLY = """e AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)"""


@query(f"""WITH RECURSIVE {_SUPPLY}, g AS (SELECT * FROM e WHERE NOT (source || '>' || target IN (SELECT 'p' || l_partkey || '>' || 's' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'))),
w(node, depth) AS (SELECT 'p1', 0 UNION SELECT g.target, w.depth + 1 FROM w JOIN g ON w.node = g.source WHERE w.depth < 3)
SELECT node, CAST(min(depth) AS INT) AS depth FROM w GROUP BY node""")
def graph_reach_bounded(spark: SparkSession, sf: str) -> DataFrame:
    guards = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct().select(F.concat(F.lit("p"), "l_partkey", F.lit(">s"), "l_suppkey").alias("key"))
    edges = graph.unguarded(_supply_edges(spark, sf), guards)
    return graph.bounded_paths(edges, spark.createDataFrame([("p1",)], "node string"), 3, keep_path=False).select("node", "depth")


@query(f"""WITH RECURSIVE {_SUPPLY}, w(node, path) AS (SELECT 'p1', 'p1' UNION ALL SELECT e.target, w.path || '>' || e.target FROM w JOIN e ON w.node = e.source WHERE length(w.path) - length(replace(w.path, '>', '')) < 2)
SELECT node, CAST(length(path) - length(replace(path, '>', '')) AS INT) AS depth, path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY length(path) - length(replace(path, '>', '')), string_split(path, '>')) AS n FROM w) WHERE n = 1""")
def graph_min_path(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.bounded_paths(_supply_edges(spark, sf), spark.createDataFrame([("p1",)], "node string"), 2)
    return found.select("node", "depth", F.array_join("path", ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, w.root FROM w JOIN u ON w.node = u.a) SELECT node, min(root) AS component FROM w GROUP BY node""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components over every order, with the customers and orders themselves as nodes."""
    return graph.components(table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("o"), "o_orderkey").alias("b")))


@query("""WITH c AS (SELECT DISTINCT sha256(text) AS f, CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id % 10 <> 3),
b AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS f, CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id % 10 <> 5)
SELECT CASE WHEN f IN (SELECT f FROM b) THEN 'unchanged' WHEN k IN (SELECT k FROM b) THEN 'changed' ELSE 'new' END AS state, f AS fingerprint, k AS related_key FROM c
UNION ALL SELECT 'resolved', f, k FROM b WHERE f NOT IN (SELECT f FROM c) AND k NOT IN (SELECT k FROM c)""")
def base_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    key = F.col("doc_id").cast("string").alias("related_key")
    now = docs.filter("doc_id % 10 <> 3").select(F.sha2("text", 256).alias("fingerprint"), key)
    then = docs.filter("doc_id % 10 <> 5").select(F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("fingerprint"), key)
    return joins.compare_snapshots(now, then)


_NEEDLE = "an"


@query(f"""WITH p AS (SELECT doc_id, text, unnest(range(0, len(string_split(text, '{_NEEDLE}')) - 1)) AS i, string_split(text, '{_NEEDLE}') AS parts FROM documents), b AS (SELECT doc_id, array_to_string(parts[1:i + 1], '{_NEEDLE}') AS before FROM p)
SELECT doc_id, CAST(strlen(before) AS BIGINT) AS at, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INT) AS line, CAST(length(string_split(before, chr(10))[-1]) + 1 AS INT) AS column FROM b""")
def scan_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Every occurrence in every document, with its line and column."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.located(lines.occurrences(docs, "doc_id", "text", _NEEDLE), docs, "doc_id", "at", "text")
