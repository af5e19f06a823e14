"""Untrusted values through program records, as joins alone: what a repository of one component, or a function of any size, is dealt over tasks for.

The records become tables of definitions, uses, calls and returns; reaching definitions give the moves inside functions, matched calls and
returns the ways between them (operators.dataflow). As in the ordered walk of plans.fixpoint, which this answers for without its group a
component, an assignment sees what runs before it in a pass, or was left by the pass before, and all else sees what a pass leaves; an
assignment with a known range of dominance hides what its name held. Sanitizers of a rule's policy end its flows. What it leaves out, and the
walk has, are checks by guards, the bounds of depth, which of several traces is shown, and values outside functions of other files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.semantics import POLICIES, RULES
from corvane.operators import dataflow
from corvane.operators.lineage import cut
from corvane.plans.fixpoint import TRANSPARENT, program_of_events, resolve
from corvane.plans.registry import query, table

#: Stands for rules that no sanitizer clears.
UNCLEARED = "-"


def _policy(name: Column) -> Column:
    """The sanitizer policy that a name tells, or null."""
    plain = F.translate(F.lower(F.coalesce(name, F.lit(""))), "-_.:", "")
    hit = F.lit(None).cast("string")
    for policy, words in reversed(list(POLICIES.items())):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(plain, F.lit(word))
        hit = F.when(found, policy).otherwise(hit)
    return hit


def flow_tables(records: DataFrame) -> dict[str, DataFrame]:
    """records (plans.fixpoint.RECORDS) -> definitions, uses (for dataflow.reaching_definitions), calls, returns, seeds, sinks and sanitizers. Nodes are records, the arguments of calls, and the results of functions."""
    node = F.concat_ws("\x1f", "repository", "record_id")
    rows = resolve(cut(records)).withColumn("node", node)
    scope = F.concat_ws("\x1f", "repository", F.coalesce("function", F.concat(F.lit("\x1e"), "path")))
    place = F.greatest(F.coalesce("evaluation_order", "start_byte"), F.lit(0))
    rows = cut(rows.withColumns({"scope": scope, "place": place, "policy": F.when(F.col("kind") == "sanitizer", _policy(F.coalesce("name", "callee"))), "leaf": F.split_part(F.coalesce("callee", F.lit("")), F.lit("."), F.lit(-1))}))
    span = (rows.agg(F.max("place")).first()[0] or 0) + 1
    inputs = rows.select("*", F.explode("values").alias("v")).filter("v.value != ''").select("*", "v.slot", F.col("v.property").alias("given"), F.col("v.value").alias("value"))
    own = F.exists(F.coalesce("values", F.array().cast(rows.schema["values"].dataType)), lambda v: F.coalesce((v.value == F.col("output")) | F.startswith(v.value, F.concat("output", F.lit("."))) | F.startswith(v.value, F.concat("output", F.lit("["))) | F.startswith("output", F.concat(v.value, F.lit("."))) | F.startswith("output", F.concat(v.value, F.lit("["))), F.lit(False)))
    passes = F.col("target").isNotNull() & F.col("kind").isin("call", "transformation", "guard")
    carries = ~passes & (F.col("kind").isin("assignment", "alias", "transformation") | ((F.col("kind") == "sanitizer") & F.col("policy").isNotNull()) | ((F.col("kind") == "call") & F.col("leaf").isin(*TRANSPARENT)))
    strong = (F.col("kind") == "assignment") & F.col("dominance_start").isNotNull() & ~own
    made = rows.filter(F.col("output").isNotNull() & (carries | passes | (F.col("kind") == "source")))
    twice = F.explode(F.array(F.lit(0), F.lit(span))).alias("pass")  # a pass, and the one after it
    definitions = made.select("scope", "output", "place", strong.alias("strong"), "node", twice).select(
        F.col("scope").alias("function"), F.col("output").alias("name"), (F.col("place") + F.col("pass")).cast("long").alias("at"), F.when(F.col("strong"), F.lit(4 * span)).cast("long").alias("end"), F.col("node").alias("definition")
    )
    ordered = F.col("kind").isin("assignment", "alias", "transformation")
    at = F.when(ordered & ~passes, F.col("place") + span).otherwise(2 * span).cast("long").alias("at")
    result = F.concat_ws("\x1f", "repository", F.lit("\x1ereturn"), "function")
    whole = F.col("name").isin("prototype-mutation", "sensitive-data-disclosure", "sensitive-mutation") | F.col("leaf").isin("Function", "rename")
    second = (F.col("name") == "cli-option-injection") | F.col("leaf").isin("spawn", "execFile")
    to_sink = (F.col("kind") == "sink") & (F.coalesce(whole, F.lit(False)) | (F.col("slot") == 0) | (F.coalesce(second, F.lit(False)) & (F.col("slot") == 1)))
    use = F.when(F.col("kind") == "return", result).when(carries | to_sink, F.col("node"))
    uses = inputs.select(F.col("scope").alias("function"), F.col("value").alias("name"), at, use.alias("use")).filter("use IS NOT NULL")
    parameters = rows.filter("kind = 'argument' AND output IS NOT NULL AND size(values) > 0").select("repository", F.col("function").alias("target"), F.get("values", F.lit(0))["slot"].alias("slot"), F.get("values", F.lit(0))["property"].alias("part"), F.col("node").alias("formal"), F.col("scope").alias("inside"), F.col("output").alias("parameter"), F.col("path").alias("where"))
    actual = F.concat_ws("\x1f", "node", F.col("slot").cast("string"), F.coalesce("part", F.lit("")))
    bound = cut(inputs.filter(passes).join(parameters, ["repository", "target", "slot"]).withColumn("actual", actual))
    handed = bound.select(F.col("scope").alias("function"), F.concat_ws(".", "value", "part").alias("name"), at, F.col("actual").alias("use"))
    # A parameter holds what a call put there when the call ran: files run in the order of their paths.
    ran = F.when(F.col("path") == F.col("where"), F.col("place")).when(F.col("path") < F.col("where"), 0).otherwise(span - 1)
    put = bound.select("inside", "parameter", ran.alias("ran"), "formal").distinct().select("*", twice)
    put = put.select(F.col("inside").alias("function"), F.col("parameter").alias("name"), (F.col("ran") + F.col("pass")).cast("long").alias("at"), F.lit(None).cast("long").alias("end"), F.col("formal").alias("definition"))
    back = F.concat_ws("\x1f", "repository", F.lit("\x1ereturn"), "target")
    return {
        "definitions": definitions.unionByName(put), "uses": uses.unionByName(handed).distinct(), "calls": bound.select(F.col("node").alias("site"), "actual", "formal").distinct(),
        "returns": rows.filter(passes & F.col("output").isNotNull()).select(F.col("node").alias("site"), back.alias("result"), F.col("node").alias("output")).distinct(),
        "seeds": rows.filter("kind = 'source' AND output IS NOT NULL").select("node"), "sinks": rows.filter("kind = 'sink'").select("node", "repository", "path", "function", F.col("start_byte").alias("sink_start"), F.col("name").alias("sink_kind")),
        "sanitizers": rows.filter("policy IS NOT NULL").select("node", "policy"),
    }


def reached_sinks(records: DataFrame) -> DataFrame:
    """repository, path, function, sink_start, rule_id of the sinks that an untrusted source reaches with nothing on its way that clears the rule.

    Each policy that clears rules has its own copy of the flows, without the sanitizers of that policy; policies of which the records have no
    sanitizer share one with the rules that nothing clears. So there are as many copies as there are policies, at most.
    """
    spark, t = records.sparkSession, flow_tables(records)
    moves = cut(dataflow.reaching_definitions(t["definitions"], t["uses"], members=False).select(F.col("definition").alias("source"), F.col("use").alias("target")).distinct())
    clearing = {r.policy for r in t["sanitizers"].select("policy").distinct().collect()} & {policy for _, _, policy, _, _ in RULES}  # of POLICIES, so a handful
    copies = F.explode(F.array(*map(F.lit, [*sorted(clearing), UNCLEARED]))).alias("copy")
    kept = moves.join(t["sanitizers"].select(F.col("node").alias("target"), "policy"), "target", "left").select("source", "target", "policy", copies).filter("policy IS NULL OR policy != copy")

    def named(frame: DataFrame, *columns: str) -> DataFrame:
        own = frame if "copy" in frame.columns else frame.select("*", copies)
        return own.select(*[F.concat_ws("\x1f", "copy", c).alias(c) for c in columns])

    found = dataflow.matched_reachability(named(kept, "source", "target"), named(t["calls"], "site", "actual", "formal"), named(t["returns"], "site", "result", "output"), named(t["seeds"], "node"))
    rules = spark.createDataFrame([(rule, kind, policy if policy in clearing else UNCLEARED) for rule, kind, policy, _, _ in RULES], "rule_id string, sink_kind string, policy string")
    wanted = t["sinks"].join(F.broadcast(rules), "sink_kind").withColumn("at", F.concat_ws("\x1f", "policy", "node"))
    return wanted.join(found.select(F.col("node").alias("at")).distinct(), "at", "left_semi").select("repository", "path", "function", "sink_start", "rule_id")


@query("""WITH k AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS killed FROM events GROUP BY user_id),
a AS (SELECT DISTINCT e.user_id FROM events e JOIN k USING (user_id) WHERE event_type = 'signup' AND e.event_id > coalesce(killed, -1))
SELECT 'u' || user_id || '.ts' AS path, event_id AS sink_start, 'SE1001' AS rule_id FROM events JOIN a USING (user_id) WHERE event_type = 'purchase'
UNION ALL SELECT DISTINCT 'h' || user_id || '.ts', 5, 'SE1005' FROM events JOIN a USING (user_id) WHERE event_type = 'view'""")
def flow_records(spark: SparkSession, sf: str) -> DataFrame:
    """The program of fixpoint_records, by joins: every purchase of a user whose x is alive in the end, and through a view the helper."""
    return reached_sinks(program_of_events(table(spark, sf, "events").select("event_id", "user_id", "event_type"))).select("path", "sink_start", "rule_id")




def program_of_lines(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Every order as a function whose lines, in order, call their part's function and hand on what that gives; a part's function calls that of each of its suppliers.

    A part gives what a supplier gave whose balance is up to 100 above the part's price; a supplier hands on what it got if its balance is
    over 1000, and one below 0 gives a value of its own. Orders of the highest priority begin with an untrusted value. All lines also go
    through one function of their status, which has a third of all calls.
    """
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    orders, supplier, part = (table(spark, sf, t) for t in ("orders", "supplier", "part"))
    name = lambda prefix, *c: F.concat(F.lit(prefix), F.concat_ws(".", *c))
    here, got = name("o", "l_orderkey", "l_linenumber"), name("x", "l_orderkey", "l_linenumber")
    status, given, gone = name("m", "l_linestatus"), name("mr", "l_linestatus"), name("y", "l_orderkey", "l_linenumber")
    pairs = line.select("l_partkey", "l_suppkey")
    site, middle = name("c", "l_partkey", "l_suppkey"), name("pm", "l_partkey", "l_suppkey")
    after = line.select("l_orderkey", F.col("l_linenumber").alias("n")).distinct()
    chain = after.select("l_orderkey", F.col("n").alias("l_linenumber")).join(after, ["l_orderkey"]).filter("n = l_linenumber + 1").select(gone.alias("source"), name("o", "l_orderkey", "n").alias("target"))
    priced = pairs.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    moves = [
        chain, priced.filter("s_acctbal BETWEEN p_retailprice AND p_retailprice + 100").select(middle.alias("source"), name("pr", "l_partkey").alias("target")),
        supplier.filter("s_acctbal > 1000").select(name("s", "s_suppkey").alias("source"), name("sr", "s_suppkey").alias("target")), supplier.filter("s_acctbal < 0").select(name("sx", "s_suppkey").alias("source"), name("sr", "s_suppkey").alias("target")),
        line.filter("l_linestatus = 'O'").select(status.alias("source"), given.alias("target")).distinct(),
    ]
    calls = [line.select(name("a", "l_orderkey", "l_linenumber").alias("site"), here.alias("actual"), name("p", "l_partkey").alias("formal")), line.select(name("b", "l_orderkey", "l_linenumber").alias("site"), got.alias("actual"), status.alias("formal")), pairs.select(site.alias("site"), name("p", "l_partkey").alias("actual"), name("s", "l_suppkey").alias("formal"))]
    returns = [line.select(name("a", "l_orderkey", "l_linenumber").alias("site"), name("pr", "l_partkey").alias("result"), got.alias("output")), line.select(name("b", "l_orderkey", "l_linenumber").alias("site"), given.alias("result"), gone.alias("output")), pairs.select(site.alias("site"), name("sr", "l_suppkey").alias("result"), middle.alias("output"))]
    urgent = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    seeds = [line.filter("l_linenumber = 1").join(urgent, "l_orderkey", "left_semi").select(here.alias("node")), supplier.filter("s_acctbal < 0").select(name("sx", "s_suppkey").alias("node"))]
    whole = lambda frames: frames[0].unionByName(frames[1]) if len(frames) == 2 else whole([frames[0].unionByName(frames[1]), *frames[2:]])
    return {"moves": whole(moves), "calls": whole(calls), "returns": whole(returns), "seeds": whole(seeds)}


@query("""WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_linestatus AS m FROM lineitem),
q AS (SELECT DISTINCT p, s, s_acctbal BETWEEN p_retailprice AND p_retailprice + 100 AS hands, s_acctbal > 1000 AS through, s_acctbal < 0 AS own FROM l JOIN supplier ON s = s_suppkey JOIN part ON p = p_partkey),
g AS (SELECT p, bool_or(hands AND through) AS passes, bool_or(hands AND own) AS taints FROM q GROUP BY p),
k AS (SELECT l.*, coalesce(passes, false) AS passes, coalesce(taints, false) AS taints FROM l LEFT JOIN g USING (p)),
u AS (SELECT o_orderkey AS o FROM orders WHERE o_orderpriority = '1-URGENT'),
w(o, n, kind) AS (
  SELECT o, n, 'o' FROM k JOIN u USING (o) WHERE n = 1 UNION SELECT o, n, 'x' FROM k WHERE taints
  UNION SELECT k2.o, k2.n, CASE WHEN w.kind = 'o' THEN 'x' WHEN w.kind = 'x' THEN 'y' ELSE 'o' END FROM w JOIN k k2 ON k2.o = w.o
    WHERE (w.kind = 'o' AND k2.n = w.n AND k2.passes) OR (w.kind = 'x' AND k2.n = w.n AND k2.m = 'O') OR (w.kind = 'y' AND k2.n = w.n + 1)),
e AS (SELECT DISTINCT p FROM w JOIN k ON w.o = k.o AND w.n = k.n WHERE w.kind = 'o'),
f AS (SELECT DISTINCT q.* FROM q JOIN e USING (p)),
t AS (SELECT DISTINCT s, through FROM f),
a AS (
  SELECT kind || o || '.' || n AS node, false AS entered FROM w
  UNION ALL SELECT 'sx' || s_suppkey, false FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'sr' || s_suppkey, false FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'pm' || p || '.' || s, false FROM q WHERE own UNION ALL SELECT 'pr' || p, false FROM g WHERE taints
  UNION ALL SELECT 'p' || p, true FROM e UNION ALL SELECT 's' || s, true FROM t UNION ALL SELECT 'sr' || s, true FROM t WHERE through
  UNION ALL SELECT 'pm' || p || '.' || s, true FROM f WHERE through UNION ALL SELECT 'pr' || p, true FROM f WHERE through AND hands
  UNION ALL SELECT DISTINCT 'm' || m, true FROM w JOIN k ON w.o = k.o AND w.n = k.n WHERE w.kind = 'x'
  UNION ALL SELECT DISTINCT 'mr' || m, true FROM w JOIN k ON w.o = k.o AND w.n = k.n WHERE w.kind = 'x' AND m = 'O')
SELECT node, min(entered::INT)::BOOLEAN AS entered FROM a GROUP BY node""")
def flow_matched_calls(spark: SparkSession, sf: str) -> DataFrame:
    t = program_of_lines(spark, sf)
    return dataflow.matched_reachability(t["moves"], t["calls"], t["returns"], t["seeds"])


_NAMES = "CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 3 = 1 THEN 'a.b' ELSE 'c' END"
_RANGE = "CASE event_type WHEN 'error' THEN event_id + 700 WHEN 'signup' THEN event_id + 100000 END"


@query(f"""WITH d AS (SELECT user_id, {_NAMES} AS name, event_id AS at, {_RANGE} AS upto FROM events WHERE event_type <> 'purchase'), u AS (SELECT user_id, {_NAMES} AS name, event_id AS at FROM events WHERE event_type = 'purchase')
SELECT u.at AS use, d.at AS definition FROM u JOIN d ON d.user_id = u.user_id AND d.at < u.at AND (d.name = u.name OR starts_with(u.name, d.name || '.') OR starts_with(d.name, u.name || '.'))
WHERE NOT EXISTS (SELECT 1 FROM d k WHERE k.user_id = u.user_id AND k.upto IS NOT NULL AND k.at > d.at AND k.at < u.at AND k.upto >= u.at AND (k.name = d.name OR starts_with(d.name, k.name || '.')))""")
def flow_reaching_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events define three names (one a member of another); errors hide what was for seven hundred places, sign-ups for good; purchases use."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type").withColumn("name", F.expr(_NAMES))
    definitions = events.filter("event_type != 'purchase'").select(F.col("user_id").alias("function"), "name", F.col("event_id").alias("at"), F.expr(_RANGE).alias("end"), F.col("event_id").alias("definition"))
    uses = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("function"), "name", F.col("event_id").alias("at"), F.col("event_id").alias("use"))
    return dataflow.reaching_definitions(definitions, uses)


@query("""WITH t AS (SELECT l_suppkey AS sink, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS specific, l_orderkey % 1000 AS source, l_shipdate::DATE::VARCHAR AS path,
  list_sort(list_distinct(list_filter([CASE WHEN l_linestatus = 'O' THEN 'open' END, CASE WHEN l_quantity > 25 THEN 'many' END, CASE WHEN l_tax > 0.04 THEN 'taxed' END], lambda x: x IS NOT NULL))) AS proofs FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY sink, specific, source, path ORDER BY len(proofs) DESC, proofs) AS n FROM t),
b AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY specific DESC, source, len(proofs), path) AS best FROM p WHERE n = 1)
SELECT sink, specific, source, path, array_to_string(proofs, ',') AS proofs FROM b WHERE best = 1""")
def agg_best_trace(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's lines as traces: returned ones are less specific, days are paths, properties of a line are proofs."""
    line = table(spark, sf, "lineitem")
    proofs = F.filter(F.array(F.when(F.col("l_linestatus") == "O", "open"), F.when(F.col("l_quantity") > 25, "many"), F.when(F.col("l_tax") > 0.04, "taxed")), lambda x: x.isNotNull())
    traces = line.select(F.col("l_suppkey").alias("sink"), F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("specific"), (F.col("l_orderkey") % 1000).alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("path"), proofs.alias("proofs"))
    best = dataflow.best_traces(dataflow.trace_states(traces, ["sink"]), ["sink"], [-F.col("specific"), F.col("source")])
    return best.select("sink", "specific", "source", "path", F.array_join("proofs", ",").alias("proofs"))


@query("""WITH s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000), p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN s ON l_suppkey = s_suppkey),
o AS (SELECT l_orderkey FROM lineitem LEFT JOIN p USING (l_partkey) GROUP BY l_orderkey HAVING bool_and(p.l_partkey IS NOT NULL)),
c AS (SELECT o_custkey FROM orders LEFT JOIN o ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey HAVING bool_and(l_orderkey IS NOT NULL)),
n AS (SELECT DISTINCT c_nationkey FROM customer JOIN c ON c_custkey = o_custkey)
SELECT 's' || s_suppkey AS fact, 0 AS round FROM s UNION ALL SELECT 'p' || l_partkey, 1 FROM p UNION ALL SELECT 'o' || l_orderkey, 2 FROM o UNION ALL SELECT 'c' || o_custkey, 3 FROM c UNION ALL SELECT 'n' || c_nationkey, 4 FROM n""")
def auth_horn_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a good balance are trusted, a part of any such supplier is, an order is if all its parts are, a customer if all their orders are, a nation if any customer is."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    line, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    filled = cut(line.select(F.col("l_orderkey").alias("o_orderkey")).distinct())
    known = cut(orders.join(filled, "o_orderkey", "left_semi"))
    either = lambda frame, head, premise: frame.select(premise.alias("premise"), head.alias("head"))
    every = lambda frame, head, premise: frame.select(head.alias("clause"), premise.alias("premise"))
    own = lambda frame, head: frame.select(head.alias("clause"), head.alias("head"))
    clauses = own(filled, name("o", "o_orderkey")).unionByName(own(known.select("o_custkey").distinct(), name("c", "o_custkey")))
    premises = every(line, name("o", "l_orderkey"), name("p", "l_partkey")).unionByName(every(known, name("c", "o_custkey"), name("o", "o_orderkey")))
    single = either(line, name("p", "l_partkey"), name("s", "l_suppkey")).unionByName(either(table(spark, sf, "customer"), name("n", "c_nationkey"), name("c", "c_custkey")))
    facts = table(spark, sf, "supplier").filter("s_acctbal > 8000").select(name("s", "s_suppkey").alias("fact"))
    return dataflow.horn_closure(clauses, premises, facts, implications=single)


@query("""WITH x AS (SELECT l_orderkey || '.' || l_linenumber AS use, 'r' || n.n_regionkey AS origin, 4 AS hops FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n.n_nationkey
UNION ALL SELECT l_orderkey || '.' || l_linenumber, 'r' || n.n_regionkey, 3 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation n ON s_nationkey = n.n_nationkey
UNION ALL SELECT l_orderkey || '.' || l_linenumber, p_brand, 2 FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT use, origin, CAST(min(hops) AS INT) AS hops FROM x GROUP BY use, origin""")
def graph_dag_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """A line derives from its order, supplier and part, these from customers, nations and brands: origins are regions and brands.

    Nothing derives from a line, so lines are uses of what they derive from, a step nearer to the origins.
    """
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    way = lambda t, node, parent: table(spark, sf, t).select(node.alias("node"), parent.alias("parent"))
    line = F.concat_ws(".", F.col("l_orderkey"), F.col("l_linenumber"))
    ways = [
        way("orders", name("o", "o_orderkey"), name("c", "o_custkey")), way("customer", name("c", "c_custkey"), name("n", "c_nationkey")), way("supplier", name("s", "s_suppkey"), name("n", "s_nationkey")),
        way("nation", name("n", "n_nationkey"), name("r", "n_regionkey")), way("part", name("p", "p_partkey"), F.col("p_brand")),
    ]
    parents = ways[0]
    for more in ways[1:]:
        parents = parents.unionByName(more)
    uses = table(spark, sf, "lineitem").select(line.alias("use"), F.explode(F.array(name("o", "l_orderkey"), name("s", "l_suppkey"), name("p", "l_partkey"))).alias("node"))
    origins = table(spark, sf, "region").select(name("r", "r_regionkey").alias("node")).unionByName(table(spark, sf, "part").select(F.col("p_brand").alias("node")).distinct())
    return dataflow.dag_origins(uses, parents, origins, rounds=9).select("use", "origin", (F.col("hops") + 1).alias("hops"))
