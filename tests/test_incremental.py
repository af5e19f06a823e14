import json

import pytest

from corvane.functions.settings import Settings
from corvane.plans import incremental
from corvane.plans.fixpoint import RECORDS, candidates, record
from corvane.plans.incremental import FlowStore, candidates_since
from corvane.plans.report import scan_report
from corvane.sources import versions
from tests.compare import rows_of


def program(*names, calls=(), extra=()):
    """A file each with a flow of its own, and calls of a helper of a file in another."""
    rows = [r for name in names for r in (record("function", 0, f"{name}::f", name, name=f"f{name[0]}", language="python"), record("source", 10, f"{name}::f", name, name="http-query", output="x", language="python"), record("sink", 30, f"{name}::f", name, values=["x"], name="process-execution", callee="exec", language="python"))]
    rows += [record("call", 20, f"{a}::f", a, values=["x"], callee=f"f{b[0]}", output="y", language="python") for a, b in calls]
    return rows + list(extra)


def go_on(spark, rows, store, depth=4):
    """What a scan finds with the store is what one without it finds; how many components it walked."""
    frame = spark.createDataFrame(rows, RECORDS)
    found, n = candidates_since(frame, store, depth, "1")
    assert rows_of(found.drop("component")) == rows_of(candidates(frame, depth).drop("component"))
    return n


def test_only_what_changed_is_walked(spark, tmp_path):
    store, names = FlowStore(spark, str(tmp_path / "s")), ("a.py", "b.py", "c.py")
    calls = [("a.py", "b.py")]
    assert go_on(spark, program(*names, calls=calls), store) == 2
    assert go_on(spark, program(*names, calls=calls)[::-1], store) == 0  # in any order
    more = record("sink", 50, "c.py::f", "c.py", values=["x"], name="redirect", callee="go", language="python")
    assert go_on(spark, program(*names, calls=calls, extra=[more]), store) == 1
    assert go_on(spark, program("a.py", "c.py", calls=calls), store) == 1  # b went: a is alone, c as at first
    # A second function of b's name elsewhere: no file of a's component changed, but its call names nothing now.
    twin = record("function", 0, "d.py::fb", "d.py", name="fb", language="python")
    assert go_on(spark, program(*names, calls=calls, extra=[twin]), store) == 2  # b, and d; a alone was met before
    assert go_on(spark, program(*names, calls=calls), store, depth=3) == 2
    assert go_on(spark, [], store) == 0


def test_what_is_cut_short_does_not_count(spark, tmp_path, monkeypatch):
    store = FlowStore(spark, str(tmp_path / "s"))
    rows = program("a.py", "b.py")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(FlowStore, "_log", lambda *a: (_ for _ in ()).throw(RuntimeError("the driver went")))
        candidates_since(spark.createDataFrame(rows, RECORDS), store, 4, "1")
    assert store.versions() == [] and go_on(spark, rows, store) == 2 and go_on(spark, rows, store) == 0
    (tmp_path / "s/log/000000002").write_text('{"version": "v-')  # an entry that was cut short
    assert go_on(spark, rows, store) == 0 and go_on(spark, program("c.py"), store) == 1
    assert sorted(p.name for p in (tmp_path / "s/log").glob("0*")) == ["000000001", "000000002", "000000003"]


def test_versions_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_VERSIONS", 2)
    monkeypatch.setattr(versions, "GRACE_SECONDS", -1)
    store = FlowStore(spark, str(tmp_path / "s"))
    for names in (["a.py"], ["a.py", "b.py"]):
        assert go_on(spark, program(*names), store) == 1
    assert len(store.versions()) == 2
    assert go_on(spark, program("b.py", "c.py"), store) == 1  # joins all, and a is in use no more
    assert len(store.versions()) == 1 and store.keys().count() == 2 and len(list((tmp_path / "s").glob("v-*"))) == 1
    assert go_on(spark, program("b.py", "c.py"), store) == 0


def test_a_scan_with_a_cache(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()
    body = "import {{ exec }} from 'child_process';\nexport function h(req) {{\n  exec(req.query.q{0});\n}}\n"
    for i in range(3):
        (src / f"f{i}.ts").write_text(body.format(i))
    first = scan_report(spark, str(src), Settings(), cache=cache)
    again = scan_report(spark, str(src), Settings(), cache=cache)
    assert (first.header["components_walked"], again.header["components_walked"], again.header["cache_hits"]) == (3, 0, 3)
    assert rows_of(first.findings) == rows_of(again.findings) and first.findings.count() == 3
    (src / "f1.ts").write_text(body.format(9).replace("exec(", "  exec("))
    last = scan_report(spark, str(src), Settings(), cache=cache)
    assert last.header["components_walked"] == 1 and rows_of(last.findings) == rows_of(scan_report(spark, str(src), Settings()).findings)
    assert json.dumps(last.header)
