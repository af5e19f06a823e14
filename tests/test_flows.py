import random

from corvane.plans import flows
from corvane.plans.fixpoint import EXAMPLE, RECORDS, candidates, record
from corvane.plans.flows import reached_sinks


def walked(spark, rows):
    return sorted((r.rule_id, r.path, r.sink_start) for r in candidates(spark.createDataFrame(rows, RECORDS), depth=12).collect())


def joined(spark, rows):
    return sorted((r.rule_id, r.path, r.sink_start) for r in reached_sinks(spark.createDataFrame(rows, RECORDS)).collect())


def test_example(spark):
    """In two repositories of their own; in a third the helper is missing."""
    two = [r | {"repository": x} for r in EXAMPLE for x in ("one", "two")] + [r | {"repository": "three"} for r in EXAMPLE if r["path"] == "a.ts"]
    got = sorted(map(tuple, reached_sinks(spark.createDataFrame(two, RECORDS)).select("repository", "rule_id", "path", "sink_start").collect()))
    assert got == [("one", "SE1001", "a.ts", 30), ("two", "SE1001", "a.ts", 30)]


def module(rng, number, functions):
    """A file of functions with random assignments, calls of each other, sanitizers and sinks over a few names."""
    path, rows, at = f"m{number}.ts", [], 0
    names = ["a", "b", "b.c", "d"]
    for f in range(functions):
        own = {"function": f"{path}::f{f}", "path": path}
        rows.append(record("function", at, name=f"f{f}", **own))
        rows.append(record("argument", at + 1, values=[""], output="a", **own))
        at += 10
        for _ in range(rng.randint(3, 7)):
            kind, x, y = rng.choice(["source", "assignment", "assignment", "call", "call", "sanitizer", "sink", "sink", "return"]), rng.choice(names), rng.choice(names)
            more = {
                "source": dict(name="http-query", output=x), "assignment": dict(output=x, values=[y], dominance_start=0 if rng.random() < 0.4 else None, dominance_end=999),
                "call": dict(callee=f"f{rng.randrange(functions)}", output=x, values=[y]), "sanitizer": dict(name=rng.choice(["escapeShell", "sqlQuote", "tidy"]), output=x, values=[y]),
                "sink": dict(name=rng.choice(["process-execution", "redirect", "database-query"]), callee="run", values=[y]), "return": dict(values=[y]),
            }[kind]
            rows.append(record(kind, at, **more, **own))
            at += 10
    return rows


def test_what_the_walk_finds_is_found(spark):
    """Whole files of random functions that call each other, recursion included: no sink that the walk finds is missed."""
    rng = random.Random(1)
    rows = [r for n in range(40) for r in module(rng, n, 3)]
    walk, joins = set(walked(spark, rows)), set(joined(spark, rows))
    assert walk <= joins and len(walk) > 5
    assert len(joins - walk) <= 0.2 * len(joins), (len(walk), len(joins))  # the walk keeps one trace a value, and one that is cleared hides others


def test_policies_without_sanitizers_share_their_flows(spark, monkeypatch):
    copies, whole = [], flows.dataflow.matched_reachability
    monkeypatch.setattr(flows.dataflow, "matched_reachability", lambda moves, *rest: copies.append(moves.selectExpr("split_part(source, '\x1f', 1) AS c").distinct().count()) or whole(moves, *rest))
    own = {"function": "a.ts::f", "path": "a.ts"}
    rows = [record("function", 0, name="f", **own), record("source", 10, name="http-query", output="x", **own)]
    sinks = [record("sink", at, name=kind, callee="run", values=["x"], **own) for at, kind in ((30, "process-execution"), (40, "redirect"), (50, "cli-option-injection"), (60, "prototype-mutation"))]
    assert joined(spark, rows + sinks) == [("SE1001", "a.ts", 30), ("SE1005", "a.ts", 40), ("SE1008", "a.ts", 50), ("SE1009", "a.ts", 60)]
    cleared = [record("sanitizer", 20, name="escapeShell", output="y", values=["x"], **own)] + [r | {"values": [v | {"value": "y"} for v in r["values"]]} for r in sinks]
    assert joined(spark, rows + cleared) == [("SE1005", "a.ts", 40), ("SE1009", "a.ts", 60)]
    assert copies == [1, 2]
