"""Values through programs as joins: matched calls and returns, reaching definitions, traces, clauses of summaries, lineage over many parents.

Nothing here gathers a function, a file or a repository in one task. Loops are semi-naive: a round joins what the last one found, drops what
is known, and is written once; how much it found is counted while it is written. Positions are whole numbers from 0; searches for "the last
before" go through cells of 16, 256, ... positions instead of a sort a key, so a hot function or name is dealt over its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corvane.operators.lineage import cut, dealt

#: Rows that stand for one hot key at the smaller side of a join, so that the larger side is dealt over as many tasks.
SALTS = 16
#: Rows of a round's table that may be broadcast: a few megabytes of names and their hash table, whatever the input.
FEW = 10_000
#: Rows of a round's table that one task may hold as a hash table: a few hundred megabytes of names.
HASHED = 2_000_000


def _grown(found: DataFrame, *sums: str) -> tuple:
    """The frame as a table, its number of rows, and the sums of these columns."""
    seen = Observation()
    table = cut(found.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]))
    return table, seen.get["rows"], *[seen.get[c] for c in sums]


def _unknown(found: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Distinct rows of found whose key is not known. An anti-join would be moved below the distinct rows and the joins that make them, and shuffle what goes in there."""
    was = known.select(*key, F.lit(True).alias("__was"))
    return found.distinct().join(was, key, "left").filter("__was IS NULL").drop("__was")


def _side(frame: DataFrame, rows: int) -> DataFrame:
    """A table of that many rows as one side of a join: broadcast only if they are few."""
    return F.broadcast(frame) if rows <= FEW else frame


def _beside(frame: DataFrame, rows: int, even: bool = True) -> DataFrame:
    """A round's table of that many rows, to be joined with one in buckets (lineage.dealt without `sorts`): broadcast if they are few, else a hash
    table a task, so that rounds read what they join and don't sort it. Sides too large for that are sorted; unless they are `even`, one task may get all."""
    most = HASHED // 8 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) if even else HASHED
    return F.broadcast(frame) if rows <= FEW else frame.hint("shuffle_hash" if rows <= most else "merge")


def _union(frames: list[DataFrame]) -> DataFrame:
    """A union of tables joins as they do (lineage.cut): hints don't pass a union by themselves."""
    return reduce(DataFrame.unionByName, frames).hint("merge")


# Calls that return where they came from


def _salted(*of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int").alias("salt")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _few(tables: list[DataFrame]) -> list[DataFrame]:
    """What a loop has found, in a handful of tables however many rounds there were."""
    return [cut(_union(tables))] if len(tables) > 8 else tables


def summary_edges(moves: DataFrame, calls: DataFrame, returns: DataFrame) -> list[DataFrame]:
    """moves (target, source) inside functions, calls (formal, salt, site, actual), returns (site, result, output), in buckets of target, of formal and salt, and
    of site and result -> tables of source, target: what goes in at a call's site and comes out at the same one, through any number of nested and recursive calls.

    Paths grow backwards from results, by moves and by summaries of calls: a function has few results, often one, but may have many parameters
    and values that no result depends on. Where one comes to a parameter, every site of the function that takes the result gets a summary, once.
    Rounds shuffle new paths, the sites they complete and known paths, no moves, calls or returns; summaries lie in buckets as moves do.
    """
    formals = cut(calls.groupBy(F.col("formal").alias("node")).agg(F.count(F.lit(1)).alias("sites")))  # a busy function's sites are salted, as one row of a path meets them all
    results = returns.filter("result IS NOT NULL").select(F.col("result").alias("node"), "result").distinct()
    delta, rows, sites = _grown(results.join(formals, "node", "left"), "sites")
    known, total = [delta], rows
    edges, summaries = [moves], []

    def longer(step: DataFrame, paths: DataFrame, n: int) -> DataFrame:
        ends = _beside(paths.select(F.col("node").alias("target"), "result"), n, even=False)
        return step.join(ends, "target").select(F.col("source").alias("node"), "result")

    while rows:
        found = [longer(step, delta, rows) for step in edges]
        if sites:
            whole = delta.filter("sites IS NOT NULL").select(F.col("node").alias("formal"), "result", _every_salt())
            through = calls.join(_beside(whole, rows * SALTS, even=rows <= HASHED), ["formal", "salt"]).select("site", "result", "actual")
            through = returns.join(_beside(through, sites), ["site", "result"]).select(F.col("output").alias("target"), F.col("actual").alias("source"))
            new = dealt(through, "target", once=False, sorts=False)
            found.append(longer(new, _union(known), total))
            summaries.append((new, sites))
            while len(summaries) > 1 and summaries[-2][1] <= 2 * summaries[-1][1]:  # so there are few of them, and each row is written anew a few times
                (one, n), (other, m) = summaries[-2:]
                summaries[-2:] = [(dealt(_union([one, other]), "target", once=False, sorts=False), n + m)]
            edges = [moves, *[table for table, _ in summaries]]
        fresh = _unknown(_union(found), _union(known), ["node", "result"])
        delta, rows, sites = _grown(fresh.join(formals, "node", "left"), "sites")
        known, total = _few([*known, delta]), total + rows
    return [table.select("source", "target") for table, _ in summaries]


def matched_reachability(moves: DataFrame, calls: DataFrame, returns: DataFrame, seeds: DataFrame) -> DataFrame:
    """moves (source, target) inside functions, calls (site, actual, formal), returns (site, result, output), seeds (node) -> node, entered: what the seeds
    reach by moves, by summaries of calls, out of the functions they stand in (any caller), and then into calls; after entering one (`entered`) a
    value leaves it only through a summary, that is, where it came in.

    All that is reached without entering comes first, so no node is reached twice and its rounds read no calls; then what is entered from there.
    Moves, calls, returns and summaries are shuffled once for each key that rounds join them on, and not sorted in a round.
    """
    moves = dealt(moves.select("target", "source"), "target", once=False, sorts=False)
    calls = dealt(calls.select("formal", _salted("site", "actual"), "site", "actual"), "formal", "salt", once=False, sorts=False)
    returns = dealt(returns.select("site", "result", "output"), "site", "result", sorts=False)  # each row once, or rows that calls and returns have twice were four summaries
    inside = dealt(_union([moves.select("source", "target"), *summary_edges(moves, calls, returns)]), "source", once=False, sorts=False)
    exits, up = cut(returns.select(F.col("result").alias("node"), F.lit(1).alias("leaves")).distinct()), None

    def along(edges: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
        return edges.join(_beside(nodes.select(F.col("node").alias("source")), n), "source").select(F.col("target").alias("node"))

    delta, rows, leaving = _grown(seeds.select("node").distinct().join(exits, "node", "left"), "leaves")
    within, total = [delta], rows
    while rows:
        found = [along(inside, delta, rows)]
        if leaving:
            gone = delta.filter("leaves IS NOT NULL").select(F.col("node").alias("result"))
            if leaving <= FEW:
                out = returns.join(F.broadcast(gone), "result")
            else:  # a busy function's result goes out to very many sites, which are salted
                up = up or dealt(returns.select("result", _salted("output"), "output"), "result", "salt", once=False, sorts=False)
                out = up.join(_beside(gone.select("result", _every_salt()), leaving * SALTS), ["result", "salt"])
            found.append(out.select(F.col("output").alias("node")))
        delta, rows, leaving = _grown(_unknown(_union(found), _union(within), ["node"]).join(exits, "node", "left"), "leaves")
        within, total = _few([*within, delta]), total + rows

    within = [table.select("node") for table in within]
    down = dealt(calls.select(F.col("actual").alias("source"), F.col("formal").alias("target")), "source", once=False, sorts=False)
    delta, rows = _grown(_unknown(along(down, _union(within), total), _union(within), ["node"]))
    entered = [delta]
    while rows:
        found = [along(inside, delta, rows), along(down, delta, rows)]
        delta, rows = _grown(_unknown(_union(found), _union([*within, *entered]), ["node"]))
        entered = _few([*entered, delta])
    reached = _union([table.select("node", F.lit(False).alias("entered")) for table in within] + [table.select("node", F.lit(True).alias("entered")) for table in entered])
    # Rounds find each node once, but can't tell that a null is known.
    return _union([reached.filter("node IS NOT NULL"), reached.filter("node IS NULL").groupBy("node").agg(F.min("entered").alias("entered"))])


# Places in order, by cells


def _levels(*places: tuple[DataFrame, str]) -> int:
    """How many levels of sixteen places hold all of them."""
    most = max((frame.agg(F.max(at)).first()[0] or 0) for frame, at in places)
    return max(1, -(-int(most + 1).bit_length() // 4))


def _covering_cells(low: Column, high: Column, levels: int) -> Column:
    """Cells (level, cell) that make up all places from low to high, both included, the largest first choice."""
    def whole(level: int) -> tuple[Column, Column]:
        return -F.shiftright(-low, 4 * level), F.shiftright(high + 1, 4 * level) - 1

    def run(level: int, first: Column, last: Column) -> Column:
        cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))

    parts = []
    for level in range(levels):
        first, last = whole(level)
        if level == levels - 1:
            parts.append(run(level, first, last))
            continue
        upper, lower = whole(level + 1)
        some = upper <= lower
        parts += [run(level, first, F.when(some, upper * 16 - 1).otherwise(last)), run(level, F.when(some, lower * 16 + 16).otherwise(last + 1), last)]
    return F.concat(*parts)


def last_covering(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """Distinct (key, at) with the start of the last span of that key that starts before the place and holds it (start < at <= end); null without one.

    A span is the cells that make it up, of which each keeps the last start only; a point asks its cell of each level. Spans go no further than
    their key's last point, and of those that start before its first point and go equally far only the last one is ever found.
    """
    places = points.select(*key, at).distinct().hint("merge")
    levels = _levels((points, at))
    asked_of = places.groupBy(*key).agg(F.min(at).alias("__first"), F.max(at).alias("__end"))
    met = spans.filter(F.col(end).isNotNull()).join(asked_of, key).filter(F.col(start) < F.least(end, "__end")).select(*key, F.col(start).alias("__start"), F.least(end, "__end").alias("__end"), F.when(F.col(start) >= F.col("__first"), F.col(start)).alias("__own"))
    met = met.groupBy(*key, "__end", "__own").agg(F.max("__start").alias("__start"))
    sized = met.select(*key, "__start", F.explode(_covering_cells(F.col("__start") + 1, F.col("__end"), levels)).alias("c"))
    last = sized.groupBy(*key, "c.level", "c.cell").agg(F.max("__start").alias("__last"))
    asked = places.select(*key, at, F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(at, 4 * i).alias("cell")) for i in range(levels)])).alias("c"))
    found = asked.select(*key, at, "c.level", "c.cell").join(last, [*key, "level", "cell"]).groupBy(*key, at).agg(F.max("__last").alias(name))
    return places.join(found, [*key, at], "left")


def count_before(points: DataFrame, marks: DataFrame, key: list[str], at: str, place: str, name: str, levels: int) -> DataFrame:
    """Distinct (key, at) with how many marks of that key stand before the place: sums of the cells to the left, a level at a time."""
    places = points.select(*key, at).distinct().hint("merge")
    struct = lambda x, i: F.struct(F.lit(i).alias("level"), F.shiftright(x, 4 * i + 4).alias("parent"), F.shiftright(x, 4 * i).bitwiseAND(15).alias("digit"))
    every = lambda x: F.explode(F.array(*[struct(x, i) for i in range(levels)])).alias("c")
    cells = marks.groupBy(*key, place).agg(F.count(F.lit(1)).alias("n")).select(*key, "n", every(F.col(place))).groupBy(*key, "c.level", "c.parent", "c.digit").agg(F.sum("n").alias("n"))
    beside = cells.groupBy(*key, "level", "parent").agg(F.collect_list(F.struct("digit", "n")).alias("cells"))  # sixteen at most
    asked = places.select(*key, at, every(F.col(at))).select(*key, at, "c.*").join(beside, [*key, "level", "parent"])
    left = F.aggregate(F.filter("cells", lambda c: c.digit < F.col("digit")), F.lit(0).cast("long"), lambda total, c: total + c.n)
    found = asked.groupBy(*key, at).agg(F.sum(left).alias(name))
    return places.join(found, [*key, at], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


# Definitions that reach


def owners(name: Column) -> Column:
    """The name and all that it is a member of: a.b.c -> a, a.b, a.b.c."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def reaching_definitions(definitions: DataFrame, uses: DataFrame, members: bool = True) -> DataFrame:
    """definitions (function, name, at, end, definition), uses (function, name, at, use) -> use, definition: which definitions a use may see.

    Those of its function and before it, of the same name, of what that is a member of, or (`members`) of a member of it. A definition with an `end` is
    a strong one: up to that place (its range of dominance) it hides all earlier ones of its name and of the name's members.
    The last strong one in force is found through cells, definitions are numbered in order, and the numbers from there to the use are
    joined by equality, so a pair is met only if it is part of the result. Definitions that are hidden from all uses, and those of names without
    one, are not numbered. Null names, places and functions take no part.
    """
    known = cut(definitions.filter("function IS NOT NULL AND name IS NOT NULL AND at IS NOT NULL").select("function", "name", F.col("at").cast("long"), F.col("end").cast("long"), "definition"))
    asked = cut(uses.filter("function IS NOT NULL AND name IS NOT NULL AND at IS NOT NULL").select("function", "name", F.col("at").cast("long"), "use"))
    named, wanted = known.select("function", "name").distinct(), asked.select("function", F.col("name").alias("used")).distinct()
    above = wanted.select("function", "used", F.explode(owners(F.col("used"))).alias("name")).join(named, ["function", "name"])
    if members:
        below = named.select("function", "name", F.explode(owners(F.col("name"))).alias("used")).join(wanted, ["function", "used"])
        above = above.unionByName(below.select(*above.columns))
    related = above.distinct().hint("merge")
    places = cut(asked.select("function", F.col("name").alias("used"), "at").distinct().join(related, ["function", "used"]).select("function", "name", "at").distinct())
    strong = known.filter("end IS NOT NULL").select("function", F.col("name").alias("owner"), F.col("at").alias("start"), "end")
    by_owner = places.select("function", "name", "at", F.explode(owners(F.col("name"))).alias("owner"))
    held = last_covering(by_owner, strong, ["function", "owner"], "at", "start", "end", "since")
    since = by_owner.join(held, ["function", "owner", "at"]).groupBy("function", "name", "at").agg(F.coalesce(F.max("since"), F.lit(0).cast("long")).alias("since"))
    since = cut(since)
    key, levels = ["function", "name"], _levels((places, "at"))
    open_to = since.groupBy(*key).agg(F.min("since").alias("__low"), F.max("at").alias("__high"))
    known = cut(known.join(open_to, key).filter("at >= __low AND at < __high").select(*known.columns))
    moments = places.unionByName(since.select(*key, F.col("since").alias("at"))).unionByName(known.select(*key, "at"))
    counted = cut(count_before(moments, known, key, "at", "at", "n", levels))
    ties = Window.partitionBy("function", "name", "at").orderBy("definition")  # definitions of one name at one place
    numbered = known.join(counted, [*key, "at"]).select(*key, (F.col("n") + F.row_number().over(ties)).alias("number"), "definition")
    upto = since.join(counted, [*key, "at"]).withColumnRenamed("n", "last").join(counted.select(*key, F.col("at").alias("since"), F.col("n").alias("first")), [*key, "since"])
    numbers = upto.filter("last > first").select(*key, "at", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("number"))
    seen = numbers.join(numbered.hint("merge"), [*key, "number"]).select("function", "name", "at", "definition")
    back = asked.withColumnRenamed("name", "used").join(related, ["function", "used"]).select("function", "name", "at", "use")
    return back.join(seen.hint("merge"), ["function", "name", "at"]).select("use", "definition")


# Traces


def trace_states(traces: DataFrame, by: list[str], path: str = "path", proofs: str = "proofs") -> DataFrame:
    """One row a (by, rank columns, path): the set of proofs that stands for the path, the largest, of equal ones the least.

    This is the state of the aggregate: states of parts, put together and taken again, are the state of the whole, in any order and number.
    """
    others = [c for c in traces.columns if c not in (*by, path, proofs)]
    own = F.array_sort(F.array_distinct(F.coalesce(proofs, F.array().cast("array<string>"))))
    ranked = traces.select(*by, *others, path, own.alias(proofs)).groupBy(*by, *others, path).agg(F.min(F.struct((-F.size(proofs)).alias("n"), proofs)).alias("best"))
    return ranked.select(*by, *others, path, F.col(f"best.{proofs}").alias(proofs))


def best_traces(states: DataFrame, by: list[str], order: list[Column], path: str = "path", proofs: str = "proofs") -> DataFrame:
    """One trace a `by`: first in the order (of specificity, source, identity, ...); of several paths the one that needed fewer proofs, then the least path.

    On one path a superset of proofs wins, of two paths the smaller set: no order of single traces says so, and a pairwise choice would
    depend on who meets whom; hence paths are settled first, and then one of them is taken.
    """
    others = [c for c in states.columns if c not in by]
    ranked = F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], F.size(proofs).alias("__n"), F.col(path).alias("__path"), F.struct(*others).alias("__row"))
    return states.groupBy(*by).agg(F.min(ranked).alias("__best")).select(*by, "__best.__row.*")


# Clauses


def horn_closure(clauses: DataFrame, premises: DataFrame, facts: DataFrame, rounds: int | None = None, implications: DataFrame | None = None) -> DataFrame:
    """clauses (clause, head), premises (clause, premise), facts (fact) -> fact, round: all that follows; a head does when all premises of one of its clauses do.

    implications (premise, head) are clauses of one premise, which need no name and no count. A round's new facts are joined to the premises
    they are, which lie in buckets, so only the facts are shuffled; of the clauses it reaches those that lack more keep how many were met.
    Premises in a circle never do. With `rounds`, what needs more of them is left out.
    """
    needs = dealt(premises.select("premise", "clause"), "premise")
    lacking = needs.groupBy("clause").agg(F.count(F.lit(1)).alias("lacks"))
    state = dealt(clauses.select("clause", "head").join(lacking, "clause", "left").select("clause", "head", F.coalesce("lacks", F.lit(0)).cast("long").alias("lacks")), "clause")
    given = facts.select("fact").unionByName(state.filter("lacks = 0").select(F.col("head").alias("fact"))).filter("fact IS NOT NULL").distinct()
    single = implications and dealt(implications.select("premise", "head").filter("premise IS NOT NULL AND head IS NOT NULL"), "premise")
    delta, rows = _grown(given.withColumn("round", F.lit(0)))
    known, n, touched = [delta], 0, None
    while rows and (rounds is None or n < rounds):
        n += 1
        new = _side(delta.select(F.col("fact").alias("premise")), rows)
        met = needs.join(new, "premise").select("clause", F.lit(1).cast("long").alias("met"))
        if touched:
            met = met.unionByName(touched.filter("met < lacks").groupBy("clause").agg(F.max("met").alias("met")))
        touched = cut(met.groupBy("clause").agg(F.sum("met").alias("met")).join(state, "clause"))
        fresh = touched.filter("met = lacks").select(F.col("head").alias("fact"))
        if single:
            fresh = fresh.unionByName(single.join(new, "premise").select(F.col("head").alias("fact")))
        delta, rows = _grown(_unknown(fresh.filter("fact IS NOT NULL"), _union(known), ["fact"]).withColumn("round", F.lit(n)))
        known.append(delta)
    return _union(known)


#: Modes of a summary that hand a principal on, and those that must also give back a trusted value.
PRINCIPAL_MODES, RETURNING_MODES = ("principal", "filtered-principal", "enforced"), ("filtered-principal", "enforced")


def authorization_summaries(candidates: DataFrame, values: DataFrame, calls: DataFrame, inputs: DataFrame, rounds: int | None = None) -> DataFrame:
    """candidates (candidate, function, policy, mode), values (candidate, role: checked or accepted, value), calls (function, value, target or null, trusted: an outside resolver of principals),
    inputs (function, value, input) -> function, policy, mode of the candidates that hold.

    A value is trusted if it comes from an outside resolver, from a call of a function with a summary that hands a principal on, or, where
    no function of the code is called, if one of its inputs is. A candidate holds if one of its checked values is trusted and, in modes
    that give a value back, one of its accepted values too.
    """
    def fact(*parts) -> Column:
        return F.concat_ws("\x1f", *[F.lit(p) if p.startswith("=") else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])

    trusted = fact("=value", "function", "value")
    own = candidates.select("candidate", "function", "policy", "mode").distinct()
    by_role = own.join(values, "candidate")
    checks = by_role.select(fact("=any", "role", "candidate", "value").alias("clause"), fact("=any", "role", "candidate").alias("head"), trusted.alias("premise"))
    called = calls.filter("target IS NOT NULL").select("function", "value", "target").distinct()
    from_calls = called.select(fact("=call", "function", "value", "target").alias("clause"), trusted.alias("head"), fact("=summary", "target").alias("premise"))
    derived = inputs.join(called.select("function", "value").distinct(), ["function", "value"], "left_anti")
    from_inputs = derived.select(fact("=input", "function", "value", "input").alias("clause"), trusted.alias("head"), F.concat_ws("\x1f", F.lit("=value"), "function", "input").alias("premise"))
    holds = own.select(fact("=holds", "candidate").alias("clause"), fact("=holds", "candidate").alias("head"), F.explode(F.when(F.col("mode").isin(*RETURNING_MODES), F.array(F.lit("checked"), F.lit("accepted"))).otherwise(F.array(F.lit("checked")))).alias("role"), "candidate")
    holds = holds.select("clause", "head", fact("=any", "role", "candidate").alias("premise"))
    handed = own.filter(F.col("mode").isin(*PRINCIPAL_MODES)).select(fact("=hands", "candidate").alias("clause"), fact("=summary", "function").alias("head"), fact("=holds", "candidate").alias("premise"))
    rules = cut(_union([checks, from_calls, from_inputs, holds, handed]))
    outside = calls.filter("target IS NULL AND trusted").select(trusted.alias("fact")).distinct()
    proven = horn_closure(rules.select("clause", "head"), rules.select("clause", "premise"), outside, rounds)
    return own.withColumn("fact", fact("=holds", "candidate")).join(proven.select("fact"), "fact", "left_semi").select("function", "policy", "mode").distinct()


# Lineage


def dag_origins(uses: DataFrame, parents: DataFrame, origins: DataFrame, rounds: int = 10) -> DataFrame:
    """uses (use, node), parents (node, parent), origins (node) -> use, origin, hops: every origin that a use derives from within `rounds` steps, with the fewest steps.

    First the nodes that any use derives from, with the ways between them, then, from the origins down, the origins of each such node once,
    whichever uses and ways share it: rows are (node, origin) pairs and never paths. All ways are shuffled once, into buckets; a round shuffles
    what it found. The uses themselves are joined last, so what nothing derives from is best a use of its parents and no node.
    """
    edges = dealt(parents.select("node", "parent").filter("node IS NOT NULL AND parent IS NOT NULL"), "node")
    delta, rows = _grown(uses.select("node").filter("node IS NOT NULL").distinct())
    needed, ways = [delta], [cut(edges.limit(0))]
    for _ in range(rounds):
        if not rows:
            break
        ways.append(cut(edges.join(_side(delta, rows), "node")))
        delta, rows = _grown(_unknown(ways[-1].select(F.col("parent").alias("node")), _union(needed), ["node"]))
        needed.append(delta)
    below = dealt(_union(ways), "parent")
    delta, rows = _grown(origins.select("node").distinct().join(_union(needed), "node", "left_semi").select("node", F.col("node").alias("origin"), F.lit(0).alias("hops")))
    known = [delta]
    for hop in range(1, rounds + 1):
        if not rows:
            break
        down = below.join(_side(delta.select(F.col("node").alias("parent"), "origin"), rows), "parent").select("node", "origin")
        delta, rows = _grown(_unknown(down, _union(known), ["node", "origin"]).withColumn("hops", F.lit(hop)))
        known.append(delta)
    return uses.select("use", "node").join(_union(known), "node").groupBy("use", "origin").agg(F.min("hops").alias("hops"))
