import json
import time

import pytest

from corvane.functions.settings import Settings
from corvane.plans.report import scan_report
from corvane.streaming import trees
from corvane.streaming.trees import Published, follow_tree
from tests.compare import rows_of

BODY = "import {{ exec }} from 'child_process';\nexport function h(req) {{\n  exec(req.query.q{0});\n}}\n"


def states(published):
    return sorted(r.state for r in published.changes().collect())


def test_findings_of_what_changed_are_published_once(spark, tmp_path, monkeypatch):
    src, store, check = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "check")
    (src / "a" / "b").mkdir(parents=True)
    (src / "a" / "f0.ts").write_text(BODY.format(0))
    (src / "a" / "b" / "f1.ts").write_text(BODY.format(1))
    published = Published(spark, f"{store}/published")
    reports = []
    monkeypatch.setattr(trees, "scan_report", lambda *a, **k: reports.append(scan_report(*a, **k)) or reports[-1])

    def run():
        time.sleep(0.2)
        follow_tree(spark, str(src), store, check, settle_ms=50).awaitTermination()
        assert rows_of(published.findings()) == rows_of(scan_report(spark, str(src), Settings()).findings)

    assert published.findings() is None
    run()
    assert states(published) == ["new", "new"] and len(reports) == 1
    run()
    assert len(reports) == 1  # nothing changed, so nothing is scanned
    (src / "a" / "f2.ts").write_text(BODY.format(2))
    run()
    assert states(published) == ["new", "unchanged", "unchanged"] and (reports[-1].header["cache_hits"], reports[-1].header["components_walked"]) == (2, 1)
    (src / "a" / "b" / "f1.ts").unlink()
    with monkeypatch.context() as m:  # the driver goes after it published, before the stream notes that the batch is done
        add = Published.add
        m.setattr(Published, "add", lambda *a, **k: (add(*a, **k), 1 / 0))
        time.sleep(0.2)
        with pytest.raises(Exception, match="division"):
            follow_tree(spark, str(src), store, check, settle_ms=50).awaitTermination()
    n = len(reports)
    run()
    assert len(reports) == n and states(published) == ["resolved", "unchanged", "unchanged"]  # the batch was there
    (src / "a" / "f0.ts").write_text(BODY.format(7))
    with monkeypatch.context() as m:  # and before it published
        m.setattr(Published, "_log", lambda *a: 1 / 0)
        time.sleep(0.2)
        with pytest.raises(Exception, match="division"):
            follow_tree(spark, str(src), store, check, settle_ms=50).awaitTermination()
    assert states(published) == ["resolved", "unchanged", "unchanged"]
    run()
    assert "unchanged" in states(published) and len(states(published)) in (2, 3) and len(published.versions()) == 1


def test_changes_by_shares(spark, tmp_path, monkeypatch):
    for i in range(5):
        for j in range(3):
            (tmp_path / f"d{i}" / f"e{j}" / "deep").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "deep" / "x.py").write_text("x = 1\n")
    (tmp_path / "top.py").write_text("")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("")
    want = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if ".git" not in str(p)) + ["."]
    for shares in (1, 4, 1000):
        monkeypatch.setattr(trees, "SHARES", shares)
        reader = trees.ChangeReader(str(tmp_path), -1000)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        found = [row for p in parts for row in reader.read(p)]
        assert sorted(r[0] for r in found) == sorted(want) and all(r[1] == (tmp_path / r[0]).is_dir() for r in found)
        assert reader.partitions({"until": 5}, {"until": 5}) == []
    assert json.dumps(reader.latestOffset())
