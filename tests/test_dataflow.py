import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import dataflow


def program(rng, functions, size):
    """A random program with recursion: nodes f.i, parameter f.0, result f.1; sites call any function."""
    nodes = {f: [f"{f}.{i}" for i in range(size)] for f in range(functions)}
    moves = {(rng.choice(nodes[f]), rng.choice(nodes[f])) for f in nodes for _ in range(size)}
    calls, returns = set(), set()
    for site in range(functions * 3):
        f, g = rng.randrange(functions), 0 if rng.random() < 0.4 else rng.randrange(functions)
        calls.add((f"s{site}", rng.choice(nodes[f]), f"{g}.0"))
        returns.add((f"s{site}", f"{g}.1", rng.choice(nodes[f])))
    return moves, calls, returns, [rng.choice(nodes[rng.randrange(functions)]) for _ in range(2)]


def plain_reach(moves, calls, returns, seeds):
    """Brute force: paths whose returns match their calls, by pairs of nodes until nothing is new."""
    same = {(a, a) for e in (moves, {c[1:] for c in calls}, {r[1:] for r in returns}) for p in e for a in p} | set(moves)
    exits = defaultdict(list)
    for site, result, output in returns:
        exits[site].append((result, output))
    while True:
        new = {(a, o) for site, a, p in calls for r, o in exits[site] if (p, r) in same}
        after = defaultdict(set)
        for a, b in same | new:
            after[a].add(b)
        grown = same | new | {(a, c) for a, b in same | new for c in after[b]}
        if grown == same:
            break
        same = grown
    best = {s: False for s in seeds}
    todo = list(best.items())
    while todo:
        node, entered = todo.pop()
        ways = [(b, entered) for a, b in same if a == node] + [(p, True) for _, a, p in calls if a == node] + [(o, False) for _, r, o in returns if r == node and not entered]
        for b, e in ways:
            if b not in best or (best[b] and not e):
                best[b] = e
                todo.append((b, e))
    return best


def test_matched_calls_and_returns(spark):
    for seed in range(2):
        moves, calls, returns, seeds = program(random.Random(seed), 5, 4)
        got = dataflow.matched_reachability(
            spark.createDataFrame(sorted(moves), "source string, target string"), spark.createDataFrame(sorted(calls), "site string, actual string, formal string"),
            spark.createDataFrame(sorted(returns), "site string, result string, output string"), spark.createDataFrame([(s,) for s in seeds], "node string"),
        )
        assert {r.node: r.entered for r in got.collect()} == plain_reach(moves, calls, returns, seeds)


def test_a_value_leaves_where_it_came_in(spark):
    """Two callers of one function: what the first passes in does not come out at the second."""
    moves = spark.createDataFrame([("f.in", "f.out"), ("a.got", "a.end"), ("b.got", "b.end"), ("f.own", "f.out2")], "source string, target string")
    calls = spark.createDataFrame([("1", "a.value", "f.in"), ("2", "b.value", "f.in")], "site string, actual string, formal string")
    returns = spark.createDataFrame([("1", "f.out", "a.got"), ("2", "f.out", "b.got"), ("2", "f.out2", "b.other")], "site string, result string, output string")
    reach = lambda *seeds: {r.node: r.entered for r in dataflow.matched_reachability(moves, calls, returns, spark.createDataFrame([(s,) for s in seeds], "node string")).collect()}
    assert reach("a.value") == {"a.value": False, "f.in": True, "f.out": True, "a.got": False, "a.end": False}
    assert reach("f.own") == {"f.own": False, "f.out2": False, "b.other": False}
    assert dataflow.matched_reachability(moves, calls, returns, moves.select(F.col("source").alias("node")).limit(0)).count() == 0


def plain_reaching(definitions, uses):
    def owner(a, b):
        return a == b or b.startswith(a + ".")

    found = set()
    for f, m, at, use in uses:
        for g, n, d, _, name in definitions:
            if None in (f, m, at, g, n, d) or f != g or d >= at or not (owner(n, m) or owner(m, n)):
                continue
            if not any(h == f and k is not None and k > d and end is not None and k < at <= end and owner(kill, n) for h, kill, k, end, _ in definitions if kill):
                found.add((use, name))
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_reaching_definitions(spark, seed):
    rng = random.Random(seed)
    names = ["a", "a.b", "a.b.c", "ab", "x", "x.y", None]
    functions = ["hot"] * 6 + ["f", "g", None]
    definitions = [(rng.choice(functions), rng.choice(names), at := rng.randrange(400), at + rng.choice([0, 3, 40, 400]) if rng.random() < 0.5 else None, f"d{i}") for i in range(220)]
    uses = [(rng.choice(functions), rng.choice(names), rng.randrange(400), f"u{i}") for i in range(150)] + [("f", "a", None, "no")]
    d = spark.createDataFrame(definitions, "function string, name string, at long, end long, definition string")
    u = spark.createDataFrame(uses, "function string, name string, at long, use string")
    got = sorted((r.use, r.definition) for r in dataflow.reaching_definitions(d, u).collect())
    assert got == plain_reaching(definitions, uses) and len(got) > 100
    assert dataflow.reaching_definitions(d.limit(0), u).count() == 0


def test_last_covering_and_counts(spark):
    rng = random.Random(5)
    spans = [(rng.choice("kkkm"), a := rng.randrange(5000), a + int(2 ** rng.uniform(0, 12)), i) for i in range(200)]
    points = [(rng.choice("kkkmz"), rng.randrange(9000)) for _ in range(300)]
    s, p = spark.createDataFrame(spans, "k string, lo long, hi long, id long"), spark.createDataFrame(points, "k string, at long")
    got = {(r.k, r["at"]): r.since for r in dataflow.last_covering(p, s, ["k"], "at", "lo", "hi", "since").collect()}
    assert got == {(k, at): max((lo for x, lo, hi, _ in spans if x == k and lo < at <= hi), default=None) for k, at in points}
    counted = {(r.k, r["at"]): r.n for r in dataflow.count_before(p, s, ["k"], "at", "lo", "n", 4).collect()}
    assert counted == {(k, at): sum(1 for x, lo, *_ in spans if x == k and lo < at) for k, at in points}


TRACE = "key int, specific int, source string, path string, proofs array<string>"


def test_traces_merge_in_any_order(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(4), rng.randrange(2), rng.choice("st"), rng.choice("pqr"), rng.sample(["w", "x", "y", "z"], rng.randrange(4))) for _ in range(300)]
    order = [-F.col("specific"), F.col("source")]
    frame = spark.createDataFrame(rows, TRACE)
    want = sorted(map(str, dataflow.best_traces(dataflow.trace_states(frame, ["key"]), ["key"], order).collect()))
    plain = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        top = min((-r[1], r[2]) for r in own)
        paths = defaultdict(list)
        for r in own:
            if (-r[1], r[2]) == top:
                paths[r[3]].append((-len(r[4]), sorted(r[4])))
        plain[key] = min((len(min(sets)[1]), p, min(sets)[1]) for p, sets in paths.items())
    assert {r.key: (len(r.proofs), r.path, r.proofs) for r in dataflow.best_traces(dataflow.trace_states(frame, ["key"]), ["key"], order).collect()} == plain
    rng.shuffle(rows)
    parts = [dataflow.trace_states(spark.createDataFrame(rows[a:b], TRACE), ["key"]) for a, b in ((0, 90), (90, 100), (100, 300))]
    for a, b, c in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        merged = dataflow.trace_states(dataflow.trace_states(parts[a].unionByName(parts[b]), ["key"]).unionByName(parts[c]).unionByName(parts[a]), ["key"])
        assert sorted(map(str, dataflow.best_traces(merged, ["key"], order).collect())) == want


def test_horn_clauses(spark):
    rng = random.Random(9)
    clauses = [(i, f"h{rng.randrange(25)}") for i in range(60)]
    premises = [(i, f"h{rng.randrange(25)}") for i, _ in clauses for _ in range(rng.choice([1, 2, 2, 3]))] + [(0, "h1"), (0, "h1")]
    facts = ["h1", "h2", "h3", "outside"]
    known, rounds, n = set(facts), {f: 0 for f in facts}, 0
    while True:
        n += 1
        new = {h for i, h in clauses if all(p in known for j, p in premises if j == i)} - known
        if not new:
            break
        known |= new
        rounds |= dict.fromkeys(new, n)
    c, p, f = spark.createDataFrame(clauses, "clause int, head string"), spark.createDataFrame(premises, "clause int, premise string"), spark.createDataFrame([(x,) for x in facts], "fact string")
    assert {r.fact: r.round for r in dataflow.horn_closure(c, p, f).collect()} == rounds and n > 2
    assert {r.fact for r in dataflow.horn_closure(c, p, f, rounds=1).collect()} == {x for x, r in rounds.items() if r <= 1}
    circle = spark.createDataFrame([(1, "a"), (2, "b"), (3, "free")], "clause int, head string")
    assert [r.fact for r in dataflow.horn_closure(circle, spark.createDataFrame([(1, "b"), (2, "a")], "clause int, premise string"), f.limit(0)).collect()] == ["free"]


def test_summaries_with_conjunctions(spark):
    """load gets its user from outside and gives back what that user may see; helper only hands the call on; open checks nothing; loop trusts itself alone."""
    candidates = spark.createDataFrame([("c1", "load", "role", "filtered-principal"), ("c2", "helper", "role", "principal"), ("c3", "open", "role", "filtered-principal"), ("c4", "loop", "role", "principal"), ("c5", "deep", "tenant", "boolean")], "candidate string, function string, policy string, mode string")
    values = spark.createDataFrame([("c1", "checked", "user"), ("c1", "checked", "other"), ("c1", "accepted", "user"), ("c2", "checked", "x"), ("c3", "checked", "user"), ("c3", "accepted", "body"), ("c4", "checked", "l"), ("c5", "checked", "y.id")], "candidate string, role string, value string")
    calls = spark.createDataFrame([("load", "session", None, True), ("helper", "x", "load", False), ("open", "user", None, True), ("loop", "l", "loop", False), ("deep", "z", "helper", False), ("deep", "other", None, False)], "function string, value string, target string, trusted boolean")
    inputs = spark.createDataFrame([("load", "user", "session"), ("deep", "y.id", "y"), ("deep", "y", "z"), ("deep", "y", "other"), ("helper", "x", "given")], "function string, value string, input string")
    got = sorted(map(tuple, dataflow.authorization_summaries(candidates, values, calls, inputs).collect()))
    assert got == [("deep", "tenant", "boolean"), ("helper", "role", "principal"), ("load", "role", "filtered-principal")]


def test_lineage_over_many_parents(spark):
    rng = random.Random(11)
    parents = {(a, b) for a in range(60) for b in (rng.randrange(max(0, a - 8), a + 1) for _ in range(3)) if b < a} | {(5, 5), (7, 9), (9, 7)}
    origins, uses = {0, 1, 3, 30}, [(f"u{i}", i) for i in range(0, 60, 3)] + [("u0", 9), ("none", None)]
    for rounds in (3, 10):
        want = {}
        for use, node in uses:
            level = {node}
            for hop in range(rounds + 1):
                for n in level & origins:
                    want.setdefault((use, n), hop)
                    want[use, n] = min(want[use, n], hop)
                level = {b for a, b in parents if a in level}
        got = dataflow.dag_origins(spark.createDataFrame(uses, "use string, node int"), spark.createDataFrame(sorted(parents), "node int, parent int"), spark.createDataFrame([(o,) for o in origins], "node int"), rounds)
        assert {(r.use, r.origin): r.hops for r in got.collect()} == want
