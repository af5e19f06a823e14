"""Relations between calls, parameters, guards and traces: bindings, summaries, lineage, aliases, steps and contracts as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import digest
from corvane.operators.lineage import cut

FAN_OUT = 64


def bind_arguments(arguments: DataFrame, parameters: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """arguments (call_id, target, slot, property, value), parameters (target, slot, property, name) -> call_id, name, value.

    By slot. A parameter that takes a property apart gets that property of an object given in parts, or that member of a whole value; a whole
    parameter gets each property of such an object as a member of its own, the first `fan_out` by name.
    """
    given, taken = arguments.withColumnRenamed("property", "given"), parameters.withColumnRenamed("property", "taken")
    order = Window.partitionBy("call_id", "slot", "name").orderBy("given")
    joined = given.join(taken, ["target", "slot"]).filter("given IS NULL OR taken IS NULL OR given = taken")
    spread = F.col("given").isNotNull() & F.col("taken").isNull()
    ranked = joined.withColumn("__n", F.when(spread, F.dense_rank().over(order)).otherwise(1)).filter(F.col("__n") <= fan_out)
    name = F.when(spread, F.concat_ws(".", "name", "given")).otherwise(F.col("name"))
    value = F.when(F.col("given").isNull() & F.col("taken").isNotNull(), F.concat_ws(".", "value", "taken")).otherwise(F.col("value"))
    return ranked.select("call_id", name.alias("name"), value.alias("value")).distinct()


def satisfied_summaries(calls: DataFrame, arguments: DataFrame, needs: DataFrame, trusted: DataFrame) -> DataFrame:
    """calls (call_id, target, caller), arguments (call_id, slot, value), needs (target, policy, slot or null for none), trusted (caller, value) -> call_id, policy.

    A call satisfies a summary of its target if every slot that the summary needs holds a trusted value of the caller.
    """
    wanted = calls.join(needs, "target")
    good = arguments.join(calls.select("call_id", "caller"), "call_id").join(trusted, ["caller", "value"]).select("call_id", "slot").distinct().withColumn("__good", F.lit(1))
    judged = wanted.join(good, ["call_id", "slot"], "left").groupBy("call_id", "policy").agg(F.min(F.when(F.col("slot").isNull(), 1).otherwise(F.coalesce("__good", F.lit(0)))).alias("all"))
    return judged.filter("all = 1").select("call_id", "policy")


def origins(uses: DataFrame, parents: DataFrame, rounds: int = 10) -> DataFrame:
    """uses (use, node), parents (node, parent, is_origin) -> use, origin, hops: the origin that a use derives from, within `rounds` steps up; others are left out.

    Every node has one parent at most, so a round is one equality join over what is still on its way.
    """
    parents = cut(parents.select("node", "parent", "is_origin"))
    frontier, done = uses.select("use", "node", F.lit(0).alias("hops")), None
    for hop in range(rounds + 1):
        at = cut(frontier.join(parents, "node"))
        found = at.filter("is_origin").select("use", F.col("node").alias("origin"), "hops")
        done = found if done is None else done.unionByName(found)
        frontier = at.filter("NOT is_origin AND parent IS NOT NULL").select("use", F.col("parent").alias("node"), F.lit(hop + 1).alias("hops"))
        if frontier.isEmpty():
            break
    return done


def resolve_aliases(aliases: DataFrame, hops: int = 8) -> DataFrame:
    """aliases (scope, name, target) -> scope, name, target, hops: what a name stands for after at most `hops` steps; a name of several targets stands for itself alone.

    Steps are doubled, so there are as many joins as `hops` has binary digits, or twice that.
    """
    power = cut(aliases.distinct().groupBy("scope", "name").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").select("scope", "name", "target", F.lit(1).alias("hops")))
    found, left = None, hops
    while True:
        if left & 1:
            found = power if found is None else cut(_after(found, power))
        left >>= 1
        if not left:
            return found
        power = cut(_after(power, power))


def _after(first: DataFrame, then: DataFrame) -> DataFrame:
    """What a name stands for by the one and then the other; where the other knows no more, by the one alone."""
    more = then.select("scope", F.col("name").alias("target"), F.col("target").alias("__further"), F.col("hops").alias("__more"))
    joined = first.join(more, ["scope", "target"], "left")
    return joined.select("scope", "name", F.coalesce("__further", "target").alias("target"), (F.col("hops") + F.coalesce("__more", F.lit(0))).alias("hops"))


def summaries(checks: DataFrame, calls: DataFrame, rounds: int) -> DataFrame:
    """checks (function), calls (caller, callee) -> function, round: functions that check, or call one that does; the set only grows, for at most `rounds` rounds."""
    edges = cut(calls.select("caller", "callee").distinct())
    known = frontier = cut(checks.select("function").distinct().withColumn("round", F.lit(0)))
    for k in range(1, rounds + 1):
        fresh = edges.join(frontier.select(F.col("function").alias("callee")), "callee").select(F.col("caller").alias("function")).distinct()
        frontier = cut(fresh.join(known, "function", "left_anti").withColumn("round", F.lit(k)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def synthetic_guards(calls: DataFrame, summarized: DataFrame, gates: DataFrame) -> DataFrame:
    """calls (call_id, target), summarized (target, policy, mode), gates (gate, call_id) -> guard, policy: a call of a function that enforces is a guard itself; of one that answers, the gates that test what it answered. Mere authentication guards no operation."""
    wanted = calls.join(summarized.filter("policy <> 'authentication'"), "target")
    enforced = wanted.filter("mode = 'enforced'").select(F.col("call_id").alias("guard"), "policy")
    answered = wanted.filter("mode = 'boolean'").join(gates, "call_id").select(F.col("gate").alias("guard"), "policy")
    return enforced.unionByName(answered).distinct()


def resource_pairs(tenant: DataFrame, owner: DataFrame) -> DataFrame:
    """Guards (resource, principal, at) of both kinds -> resource, principal, at: where both of one principal hold on one resource. Firsts meet, so a busy resource is one row."""
    first = [g.groupBy("resource", "principal").agg(F.min("at").alias(name)) for g, name in ((tenant, "tenant_at"), (owner, "owner_at"))]
    return first[0].join(first[1], ["resource", "principal"]).select("resource", "principal", F.greatest("tenant_at", "owner_at").alias("at"))


def bound_sinks(sinks: DataFrame, pairs: DataFrame) -> DataFrame:
    """sinks (sink, resource, principal, at) with authorized: such a pair holds before."""
    held = pairs.groupBy("resource", "principal").agg(F.min("at").alias("__since"))
    return sinks.join(held, ["resource", "principal"], "left").withColumn("authorized", F.coalesce(F.col("__since") < F.col("at"), F.lit(False))).drop("__since")


def trusted_callees(calls: DataFrame, imports: DataFrame, bindings: DataFrame, modules: list[str]) -> DataFrame:
    """calls (call_id, file, root) whose root one import alone names, of one of the modules, and nothing else binds: imports (file, root, module), bindings (file, root)."""
    single = imports.distinct().groupBy("file", "root").agg(F.count("*").alias("n"), F.min("module").alias("module")).filter(F.col("n") == 1).filter(F.col("module").isin(*modules))
    return calls.join(single.select("file", "root"), ["file", "root"], "left_semi").join(bindings.select("file", "root").distinct(), ["file", "root"], "left_anti")


def realizable(nodes: Column, edges: Column) -> Column:
    """nodes: array of node ids; edges: array of struct(from_node, to_node, kind, same_file, from_at, to_at, inside): one edge between each two nodes, in place, and in order unless it crosses calls."""
    def fits(e: Column, i: Column) -> Column:
        ends = (e.from_node == F.get(nodes, i)) & (e.to_node == F.get(nodes, i + 1))
        return ends & (e.kind.isin("argument-flow", "returns", "calls") | ~e.same_file | (e.to_at >= e.from_at) | e.inside)

    return F.coalesce((F.size(edges) + 1 == F.size(nodes)) & F.forall(F.transform(edges, fits), lambda x: x), F.lit(False))


def trail_steps(found: DataFrame, records: DataFrame, key: str = "finding_id", trail: str = "trail", record: str = "record_id") -> DataFrame:
    """Each finding's trail as rows: key, ordinal (from 0), record, what the records say of it, and the edge from the step before (null for the first)."""
    steps = found.select(key, F.posexplode(trail).alias("ordinal", record), F.col(trail).alias("__trail"))
    before = F.when(F.col("ordinal") > 0, F.get("__trail", F.col("ordinal") - 1))
    edge = F.when(before.isNotNull(), digest(F.lit("step"), before, F.col(record), prefix="ge_"))
    return steps.withColumn("previous_edge", edge).drop("__trail").join(records, record, "left")


#: What a step's semantic role means in a contract: role, effect where it is proven, whether a summary may leave it out.
ROLES = {
    "untrusted-source": ("source", "preserves-influence", False), "transformation": ("propagation", "preserves-influence", True), "guard": ("guard", "blocks-influence", False),
    "sanitizer": ("sanitizer", "restricts-value", False), "authorization-check": ("authorization", "authorizes-operation", False), "sensitive-sink": ("sink", "preserves-influence", False),
}
SINK_KINDS = {
    "sink.process-execution": "os-command-execution", "sink.database-query": "sql-query-execution", "sink.filesystem-operation": "filesystem-read", "sink.outbound-request": "outbound-request",
    "sink.redirect": "redirect-response", "sink.dynamic-code-execution": "dynamic-code-evaluation",
}


def contract_steps(steps: DataFrame, key: str = "finding_id") -> DataFrame:
    """steps (key, ordinal, rule_id, role, certainty, identity, path, start, end) as a contract sees them: role, effect, kinds, summarizable; a propagation that repeats the step before it goes."""
    def looked_up(at: int, default=None) -> Column:
        return F.coalesce(*[F.when(F.col("role") == r, F.lit(v[at])) for r, v in ROLES.items()], F.lit(default))

    identity = F.col("identity")
    source_kind = F.when(F.col("rule_id") == "SE1007", "protected-resource-id").when(identity.rlike("form-data|server-action"), "form-data-value").when(identity.rlike("body|header|cookie"), "http-body-field").otherwise("http-query-value")
    sink_kind = F.coalesce(*[F.when(identity == i, k) for i, k in SINK_KINDS.items()], F.lit("protected-record-mutation"))
    effect = F.when((F.col("role") == "transformation") & ~F.coalesce(F.col("certainty") == "proven", F.lit(False)), "uncertain").otherwise(looked_up(1))
    shown = steps.filter(F.col("role").isin(*ROLES)).select(
        key, "ordinal", "rule_id", looked_up(0).alias("role"), effect.alias("effect"), F.when(F.col("role") == "untrusted-source", source_kind).alias("source_kind"),
        F.when(F.col("role") == "sensitive-sink", sink_kind).alias("sink_kind"), looked_up(2, False).alias("summarizable"), "path", "start", "end",
    )
    order = Window.partitionBy(key).orderBy("ordinal")
    here = F.struct("role", "path", "start", "end")
    return shown.withColumn("__same", F.col("summarizable") & F.coalesce(here == F.lag(here).over(order), F.lit(False))).filter("NOT __same").drop("__same")


def contracts(steps: DataFrame, taxonomy: DataFrame, key: str = "finding_id") -> DataFrame:
    """contract_steps -> key, steps, uncertain, fingerprint (meaning alone), duplicate_fingerprint (with places). taxonomy: rule_id, version, category, invariant; rules without one, and paths that don't lead from a source to a sink, have no row."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "role", "effect", "source_kind", "sink_kind", "path", "start", "end")))
    whole = steps.groupBy(key, "rule_id").agg(parts.alias("p")).withColumn("uncertain", F.exists("p", lambda s: s.effect == "uncertain"))
    whole = whole.filter((F.get("p", F.lit(0)).role == "source") & (F.element_at("p", -1).role == "sink")).join(F.broadcast(taxonomy), "rule_id")
    meaning = F.array_join(F.transform("p", lambda s: F.concat_ws("/", s.role, s.effect, F.coalesce(s.source_kind, F.lit("-")), F.coalesce(s.sink_kind, F.lit("-")))), ">")
    places = F.array_join(F.transform("p", lambda s: F.concat_ws("/", s.path, s.start.cast("string"), s.end.cast("string"))), ">")
    named = whole.withColumn("fingerprint", F.sha2(F.concat_ws("|", "version", "category", "invariant", F.col("uncertain").cast("string"), meaning), 256))
    return named.select(key, F.size("p").alias("steps"), "uncertain", "fingerprint", F.sha2(F.concat_ws("|", "fingerprint", places), 256).alias("duplicate_fingerprint"))


def helper_policies(guards: DataFrame, functions: DataFrame) -> DataFrame:
    """guards (function, policy, dominance_end), functions (function, end) -> function, policies (sorted): what is checked on every way to the function's end."""
    reaching = guards.join(functions, "function").filter(F.col("dominance_end") >= F.col("end"))
    return reaching.groupBy("function").agg(F.array_sort(F.collect_set("policy")).alias("policies"))


def candidate_budget(max_findings: int, depth: int, max_edges: int) -> int:
    return min(max_findings * (depth + 1), max_edges)


def budgeted_candidates(arrivals: DataFrame, by: list[str], arrival: str, order: list[Column], budget: int) -> DataFrame:
    """The best candidate of each key among the first `budget` keys to arrive; once the last of these has come, none is improved any more."""
    first = arrivals.groupBy(*by).agg(F.min(arrival).alias("__first"))
    last = first.orderBy("__first").limit(budget).agg(F.max("__first").alias("last"), F.count("*").alias("n")).first()
    bound = arrivals if last.n < budget else arrivals.filter(F.col(arrival) <= last["last"])
    fields = [c for c in arrivals.columns if c not in by]
    ranked = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *fields)
    return bound.groupBy(*by).agg(F.min(ranked).alias("__best")).select(*by, *[F.col(f"__best.{f}").alias(f) for f in fields])


def capped_graph(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, one row: truncated) in the order of `ordinal`: an edge stays if both its ends do; what is left out marks the graph as cut."""
    kept = cut(nodes.orderBy("ordinal").limit(max_nodes))
    ends = kept.select("node_id")
    whole = edges.join(ends.withColumnRenamed("node_id", "from_node"), "from_node", "left_semi").join(ends.withColumnRenamed("node_id", "to_node"), "to_node", "left_semi")
    left = cut(whole.orderBy("ordinal").limit(max_edges))
    counts = [f.agg(F.count("*").alias("n")).select(F.lit(of).alias("of"), (F.col("n") * sign).alias("n")) for f, of, sign in ((nodes, "nodes", 1), (kept, "nodes", -1), (edges, "edges", 1), (left, "edges", -1))]
    gone = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).groupBy("of").agg(F.sum("n").alias("n"))
    return kept, left, gone.agg(F.max(F.col("n") > 0).alias("truncated"))
