import json

import pytest
from pyspark.sql import functions as F

from corvane import cli
from corvane.functions import text
from corvane.operators import findings as ops
from corvane.plans.fixpoint import EXAMPLE, RECORDS, candidates, findings
from corvane.plans.frontend import SAMPLES


def test_operations(spark):
    found = findings(candidates(spark.createDataFrame(EXAMPLE, RECORDS))).cache()
    one = found.first()
    assert ops.matching(found, "SE1001").count() == 1 and ops.matching(found, severity="HI").count() == 1 and ops.matching(found, "nothing").count() == 0
    assert ops.explain(found, one.finding_id).count() == 1 and ops.ordered(found).first() == one
    seen = ops.assessment_preview(found, F.lit("a password=x Bearer abc"), 1000, 2000).first()
    assert seen.payload == "a [REDACTED] Bearer [REDACTED]" and seen.hidden == 2 and seen.cost_bound > 0
    known = spark.createDataFrame([(one.finding_id, one.fingerprint, "true"), ("x", "y", "false")], "finding_id string, fingerprint string, verdict string")
    assert ops.attach_assessments(found, known).first().verdict == "true"
    assert ops.attach_assessments(found, known.withColumn("fingerprint", F.lit("?"))).first().verdict == "mismatch"


def test_scalars(spark):
    row = spark.range(1).select(
        text.terminal(F.lit("a.b.c")).alias("a"), text.root(F.lit("a[0].b")).alias("b"), text.corresponds(F.lit("a"), F.lit("a.b")).alias("c"), text.corresponds(F.lit("ab"), F.lit("a")).alias("d"),
        text.bounded_name(F.lit("x" * 600)).alias("e"), F.length(text.truncated_name(F.lit("é" * 300))).alias("f"), text.safe_path(F.lit("a/../b")).alias("g"), text.safe_path(F.lit("a/b")).alias("h"),
        text.display_name(F.lit("a\x01b")).alias("i"), text.normalize_path(F.lit("a//b/./../c")).alias("j"), text.extension(F.lit("X.TAR.GZ")).alias("k"),
    ).first()
    assert tuple(row) == ("c", "a", True, False, None, 256, None, "a/b", "ab", "a/c", "gz")


def test_verbs(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    for name, body in SAMPLES.items():
        (tmp_path / "src" / name).write_text(body)
    out, base = str(tmp_path / "found"), str(tmp_path / "base.json")
    assert cli.main(["scan", str(tmp_path / "src"), "--to", out, "--json", str(tmp_path / "r.json"), "--sarif", str(tmp_path / "r.sarif"), "--history", str(tmp_path / "h")]) == 1
    assert len(json.loads((tmp_path / "r.json").read_text())["findings"]) == 3
    assert cli.main(["baseline", "create", out, base]) == 0 and cli.main(["baseline", "compare", out, base]) == 0
    assert cli.main(["list", out, "SE1003"]) == 1 and cli.main(["explain", out, "none"]) == 0
    assert cli.main(["history", "list", str(tmp_path / "h")]) == 0 and cli.main(["rules"]) == 0 and cli.main(["schema"]) == 0 and cli.main(["doctor"]) == 0
    assert cli.main(["list", str(tmp_path / "missing")]) == 2 and cli.main(["nothing"]) == 2
    (tmp_path / "src" / "f.js").write_text("export function g(req, res) { res.redirect(req.query.to); }")
    cli.main(["scan", str(tmp_path / "src"), "--to", out, "--exclude", "a.ts"])
    capsys.readouterr()
    assert cli.main(["baseline", "compare", out, base]) == 1
    assert json.loads(capsys.readouterr().out) == {"new": 1, "resolved": 1, "unchanged": 2}


def test_more_verbs(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    for name, body in SAMPLES.items():
        (tmp_path / "src" / name).write_text(body)
    report, cache = str(tmp_path / "r.json"), str(tmp_path / "cache")
    for hits in (0, 5):
        assert cli.main(["scan", str(tmp_path / "src"), "--json", report, "--cache", cache, "--history", str(tmp_path / "h"), "--progress"]) == 1
        out, err = capsys.readouterr()
        assert json.loads(out) == {"findings": 3, "files": 5, "left_out": 0, "cache_hits": hits} and err.split() == ["discovery", "parsing", "analysis", "report"]
    document = json.loads((tmp_path / "r.json").read_text())
    assert document["complete"] and document["total"] == 3 and "parser-coverage-limited" in document["header"]["limitations"]
    assert cli.main(["list", report, "--sort", "file"]) == 1
    assert [json.loads(x)["path"] for x in capsys.readouterr().out.split("\n") if x] == ["a.ts", "b.py", "c.go"]
    one = document["findings"][0]["finding_id"]
    assert cli.main(["ai", "preview", report, one]) == 0 and json.loads(capsys.readouterr().out)["finding_id"] == one
    assert cli.main(["ai", "validate", report, one, "--cache", str(tmp_path / "ai")]) == 0
    assert json.loads(capsys.readouterr().out)["verdict"] == "insufficient-evidence"
    assert cli.main(["ai", "cache", "--cache", str(tmp_path / "ai")]) == 0 and json.loads(capsys.readouterr().out) == {"cleared": 1}
    assert cli.main(["ai", "providers"]) == 0
    (tmp_path / "old.json").write_text(json.dumps({"schema": 99, "complete": True, "findings": []}))
    assert cli.main(["list", str(tmp_path / "old.json")]) == 3
    assert cli.main(["scan", str(tmp_path / "src"), "--depth", "99"]) == 2
    capsys.readouterr()
    assert cli.main(["history", "list", str(tmp_path / "h")]) == 0
    scan = json.loads(capsys.readouterr().out)["scan_id"]
    assert cli.main(["history", "show", str(tmp_path / "h"), scan]) == 0 and cli.main(["history", "delete", str(tmp_path / "h"), scan]) == 0 and cli.main(["history", "delete", str(tmp_path / "h"), scan]) == 2
    cut = json.loads((tmp_path / "r.json").read_text())
    assert cli.main(["scan", str(tmp_path / "src"), "--json", report, "--sarif", str(tmp_path / "r.sarif"), "--limit", "2"]) == 1
    cut = json.loads((tmp_path / "r.json").read_text())
    assert (cut["complete"], cut["total"], len(cut["findings"])) == (False, 3, 2)
    assert json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["properties"] == {"complete": False, "results": 3}
    assert cli.main(["list", report]) == 2  # a cut report is not read as a whole one


def test_assessments_that_do_not_belong(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "finding_id string, fingerprint string")
    good, bad, lost = (spark.createDataFrame([x], "finding_id string, fingerprint string, verdict string") for x in (("a", "1", "v"), ("a", "2", "v"), ("z", "1", "v")))
    assert ops.attach_assessments(rows, good, strict=True).filter("verdict = 'v'").count() == 1
    for some in (bad, lost):
        with pytest.raises(ValueError):
            ops.attach_assessments(rows, some, strict=True)


def test_steps_and_contracts(spark, tmp_path):
    """Moved code keeps its meaning and loses its place; rules without a taxonomy have no contract."""
    from corvane.functions.settings import Settings
    from corvane.plans.report import scan_report

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for folder, lead in (("a", ""), ("b", "// a remark\n")):
        (tmp_path / folder / "x.ts").write_text(lead + SAMPLES["a.ts"])
        (tmp_path / folder / "y.ts").write_text(lead + "export function g(req) {\n  console.log(req.query.v);\n  const v = wash(req.query.q);\n  eval(v);\n}\nfunction wash(x) {\n  return x.trim();\n}\n")
    one, two = (scan_report(spark, str(tmp_path / folder), Settings()) for folder in "ab")
    kinds = {r.path: [s.role for s in one.steps.filter(F.col("finding_id") == r.finding_id).orderBy("ordinal").collect()] for r in one.findings.filter("rule_id <> 'SE1010'").collect()}
    assert kinds["x.ts"] == ["untrusted-source", "transformation", "sensitive-sink"] and kinds["y.ts"][0] == "untrusted-source" and kinds["y.ts"][-1] == "sensitive-sink" and len(kinds["y.ts"]) > 3
    assert one.findings.count() == 3 and one.contracts.count() == 2

    def prints(report):
        rows = report.contracts.join(report.findings, "finding_id").select("path", report.contracts.fingerprint, "duplicate_fingerprint").collect()
        return {r.path: (r.fingerprint, r.duplicate_fingerprint) for r in rows}

    assert {k: v[0] for k, v in prints(one).items()} == {k: v[0] for k, v in prints(two).items()} and not {v[1] for v in prints(one).values()} & {v[1] for v in prints(two).values()}
    gone = scan_report(spark, str(tmp_path / "a"), Settings(suppressions=(("SE1001", "x.ts", one.findings.filter("path = 'x.ts'").first().sink_start, "accepted by review"), ("SE1001", "z.ts", 1, "accepted by review"))))
    assert gone.findings.count() == 2 and sorted(r.code for r in gone.suppressed.collect()) == ["applied", "stale"]
