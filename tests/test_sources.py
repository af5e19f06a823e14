import json
import os

from pyspark.sql import functions as F

from corvane.plans.fixpoint import EXAMPLE, RECORDS, candidates, findings
from corvane.sources import reports, tree
from corvane.streaming.incremental import run_once
from tests.compare import rows_of


def test_tree(spark, tmp_path):
    for name, data in {"src/main.rs": b"fn main() {}\n", "_app.tsx": b"x", "node_modules/a.js": b"x", "dist/b.js": b"x", ".git/config": b"x", ".env": b"S=1", "docs/a.md": "é\n".encode(), "big.bin": b"\x00" * 3000, "lib/.git/x": b"", "lib/c.py": b"y", "skip/me.py": b"z"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink(tmp_path / "src", tmp_path / "link")
    files = tree.read_tree(spark, str(tmp_path), exclude="skip/**", max_bytes=2000, partitions=3)
    rows = {r.path: r for r in tree.inventory(files).collect()}
    assert sorted(rows) == ["_app.tsx", "big.bin", "docs/a.md", "src/main.rs"]
    assert rows["src/main.rs"].kind == "source" and rows["src/main.rs"].entry_point == "main" and rows["docs/a.md"].kind == "documentation"
    assert rows["big.bin"].state == "too-large" and rows["_app.tsx"].parser == "tsx"
    pruned = tree.listing(str(tmp_path), {"exclude": "skip/**"})[1]
    assert pruned == {"vendor": 1, "generated": 1, "version-control": 1, "hidden": 1, "nested-repository": 1, "symbolic-link": 1, "excluded-by-config": 1}
    cache = files.filter("path = 'docs/a.md'").select(F.sha2(F.concat_ws("\x00", F.lit("1"), "path", "sha256"), 256).alias("cache_key"))
    assert tree.cache_misses(files, cache, "1").count() == 3 and tree.cache_misses(files, cache, "2").count() == 4


def test_reports(spark, tmp_path):
    found = findings(candidates(spark.createDataFrame(EXAMPLE, RECORDS)))
    assert reports.export_sarif(found, str(tmp_path / "a.sarif")) == 1
    document = json.loads((tmp_path / "a.sarif").read_text())
    result = document["runs"][0]["results"][0]
    flow = result["codeFlows"][0]["threadFlows"][0]["locations"]
    assert [(x["location"]["physicalLocation"]["artifactLocation"]["uri"], x["location"]["physicalLocation"]["region"]["byteOffset"]) for x in flow] == [("a.ts", 10), ("a.ts", 20), ("b.ts", 9), ("a.ts", 20)]
    given = spark.createDataFrame([(found.first().finding_id, found.first().fingerprint, "supported")], "finding_id string, fingerprint string, verdict string")
    reports.export_sarif(found, str(tmp_path / "a.sarif"), assessments=given)
    assert json.loads((tmp_path / "a.sarif").read_text())["runs"][0]["results"][0]["properties"]["assessment"] == "supported"
    assert result["ruleId"] == "SE1001" and result["level"] == "error" and len(document["runs"][0]["tool"]["driver"]["rules"]) == 10
    assert reports.export_json(found, str(tmp_path / "a.json")) == 1 and os.listdir(tmp_path).__len__() == 2


def test_contract(spark):
    def steps(text):
        return [{"kind": x.rstrip("?"), "skippable": x.endswith("?")} for x in text.split()]

    cases = [("source sink", "source sink", "exact"), ("source call? sink", "source sink", "exact"), ("source sink", "source call? sink", "exact"), ("source sink", "source call sink", "no_match"), ("source guard sink", "source sink", "no_match"), ("source sink", "source sink call?", "no_match"), ("source call? sink", "source value? sink", "exact")]
    step = "array<struct<kind:string,skippable:boolean>>"
    frame = spark.createDataFrame([(i, steps(e), steps(o), [True] * (len(o.split()) - 1), [], i == 0) for i, (e, o, _) in enumerate(cases)], f"i int, e {step}, o {step}, c array<boolean>, b array<string>, u boolean")
    got = {r.i: r.v for r in frame.select("i", reports.contract_verdict(F.col("e"), F.col("o"), F.col("c"), F.col("b"), F.col("u")).alias("v")).collect()}
    assert got == {i: "partial" if i == 0 else want for i, (_, _, want) in enumerate(cases)}


def test_stream_equals_batch(spark, tmp_path):
    from corvane.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    for k, part in enumerate((F.col("event_id") < 500, F.col("event_id") >= 500)):
        events.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_once(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "check"), str(tmp_path / "out"))
    got = rows_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows_of(QUERIES["taint_events"](spark, sf).select("event_id", "user_id", "source_event_id")) and got


def test_streams_in_any_order(spark, tmp_path):
    """Time decides, not numbers; several frames of a group are one list; late events meet what stands before them."""
    from datetime import datetime, timedelta

    from corvane.streaming import incremental

    start = datetime(2024, 1, 1)
    rows = [(10, 0, "signup"), (5, 10, "error"), (7, 20, "purchase"), (3, 30, "signup"), (2, 40, "purchase"), (1, 35, "view"), (9, 50, "signup"), (8, 60, "purchase")]
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type").schema
    frame = spark.createDataFrame([(e, start + timedelta(seconds=s), 1, k) for e, s, k in rows], schema)
    for k, some in enumerate(([0, 1, 2, 3], [6, 4], [5, 7])):  # the view comes after the purchase that it stands before
        frame.filter(F.col("event_id").isin([rows[i][0] for i in some])).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        run_once(spark, str(tmp_path / "in"), schema, str(tmp_path / "check"), str(tmp_path / "out"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == [(2, 3, 1), (8, 9, 1)]

    class State:
        exists = False

        def update(self, value):
            self.get, self.exists = value, True

    def part(events):
        import pandas as pd

        return pd.DataFrame([(e, start + timedelta(seconds=s), k) for e, s, k in events], columns=["event_id", "ts", "event_type"])

    state = State()
    (out,) = incremental.follow((1,), iter([part([(1, 0, "signup"), (4, 5000, "purchase")]), part([(2, 10, "view"), (3, 20, "signup")])]), state, lateness=100)
    assert out.values.tolist() == [[4, 1, 3]] and json.loads(state.get[0]) == [[json.loads(state.get[0])[0][0], 2, 0], [json.loads(state.get[0])[1][0], 3, 1]]
    (out,) = incremental.follow((1,), iter([part([(6, 5010, "purchase"), (5, 5005, "view")])]), state, lateness=100)
    assert out.values.tolist() == []


def test_nothing_vanishes(spark, tmp_path):
    for name, size in {"a.js": 10, "b.js": 5000, "c.js": 10, "d.js": 10, "e.js": 10, "deep/er/f.js": 10}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    (tmp_path / "bad\\name.js").write_bytes(b"x")
    rows = {r.path: r.state for r in tree.read_tree(spark, str(tmp_path), max_bytes=1000, max_total_bytes=25, max_files=5, max_depth=2).collect()}
    assert rows == {"a.js": "listed", "b.js": "too-large", "bad\\name.js": "unsafe-path", "c.js": "listed", "d.js": "over-budget", "e.js": "over-limit"}


def test_history_and_documents(spark, tmp_path):
    from corvane.sources.cache import History

    import pytest

    history, scan = History(str(tmp_path / "h")), "scan_" + "a" * 24
    for k, at in enumerate(["2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z"]):
        history.save(f"scan_{k:024x}", at, "r", {"n": k})
    (tmp_path / "h" / f"{scan}.json").write_text("{")
    (tmp_path / "h" / ("scan_" + "b" * 24 + ".json")).write_text(json.dumps({"scan_id": scan, "saved_at": "x", "repository": "r"}))
    scans, corrupt = history.listing()
    assert [s["body"]["n"] for s in scans] == [2, 0, 1] and corrupt == 2 and history.listing()[1] == 0
    assert history.keep(1) == 2 and [s["body"]["n"] for s in history.listing()[0]] == [2]
    with pytest.raises(ValueError):
        history.save("../x", "", "", {})
    rows = spark.createDataFrame([("b" * 64, "k1"), ("a" * 64, "k2")], "fingerprint string, related_key string")
    reports.write_baseline(rows, str(tmp_path / "base.json"))
    assert rows_of(reports.read_baseline(spark, str(tmp_path / "base.json"))) == rows_of(rows)
    good = json.loads((tmp_path / "base.json").read_text())
    for wrong in (good | {"version": 2}, good | {"kind": "x"}, good | {"findings": good["findings"][::-1]}, good | {"findings": [{"fingerprint": "short", "related_key": "k"}]}, good | {"findings": good["findings"] * 2}):
        (tmp_path / "base.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            reports.read_baseline(spark, str(tmp_path / "base.json"))
    reports.write_artifact(str(tmp_path / "x.json"), "thing", 3, {"a": 1})
    assert reports.read_artifact(str(tmp_path / "x.json"), "thing", 3)["a"] == 1
    os.symlink(tmp_path / "x.json", tmp_path / "link.json")
    with pytest.raises(OSError):
        reports.checked_document(str(tmp_path / "link.json"))


def test_assessment_documents(tmp_path):
    from corvane.sources import assessments

    import pytest

    good = assessments.mock().answer("")
    assert assessments.problem(good) is None
    for wrong in (good | {"status": "fixed"}, good | {"extra": 1}, good | {"limitations": "x"}, good | {"uncertainty": "x" * 5000}, {}, good | {"prerequisites": ["x"] * 40}):
        assert assessments.problem(wrong)
    cache = assessments.AssessmentCache(str(tmp_path), budget=1200)
    finding, calls = {"finding_id": "f", "fingerprint": "p"}, []
    provider = assessments.Provider("p", "recorded", lambda payload: calls.append(payload) or good)
    assert assessments.assess(finding, "a", provider, cache) == assessments.assess(finding, "a", provider, cache) and calls == ["a"]
    key = assessments.key_of(finding, "a", provider)
    (tmp_path / f"{key}.json").write_text("{}")
    assert cache.load(key) is None and os.path.exists(tmp_path / f"{key}.json.corrupt")
    for payload in "bcde":
        assessments.assess(finding, payload, provider, cache)
    assert sum(f.stat().st_size for f in os.scandir(tmp_path) if f.name.endswith(".json")) <= 1200
    with pytest.raises(ValueError):
        cache.load("../x")
    with pytest.raises(ValueError):
        assessments.assess(finding, "z", assessments.Provider("p", "recorded", lambda payload: {"status": "supported"}))


def test_working_copies(tmp_path):
    from corvane.sources.git import head

    a, b = "a" * 40, "b" * 64
    assert head(str(tmp_path)) == {"commit": None, "branch": None}
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "packed-refs").write_text(f"# pack\n{b} refs/heads/main\n^{a}\n{a} refs/heads/other\n")
    assert head(str(tmp_path)) == {"commit": b, "branch": "main"}
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text(a + "\n")
    assert head(str(tmp_path)) == {"commit": a, "branch": "main"}
    (tmp_path / ".git" / "worktrees" / "w").mkdir(parents=True)
    (tmp_path / ".git" / "worktrees" / "w" / "HEAD").write_text("ref: refs/heads/other\n")
    (tmp_path / ".git" / "worktrees" / "w" / "commondir").write_text("../..\n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / ".git").write_text("gitdir: ../.git/worktrees/w\n")
    assert head(str(tmp_path / "w")) == {"commit": a, "branch": "other"}
    (tmp_path / ".git" / "HEAD").write_text(b)
    assert head(str(tmp_path)) == {"commit": b, "branch": None}
    for bad in ("ref: ../../etc/passwd", "ref: refs/../x", "nonsense", "a" * 39):
        (tmp_path / ".git" / "HEAD").write_text(bad)
        assert head(str(tmp_path)) == {"commit": None, "branch": None}


def test_cache_store(spark, tmp_path):
    from corvane.plans.frontend import SAMPLES, records_of
    from corvane.plans.report import diagnostics_of
    from corvane.sources.cache import ParseCache

    (tmp_path / "src").mkdir()
    for name, body in SAMPLES.items():
        (tmp_path / "src" / name).write_text(body)
    files = tree.read_tree(spark, str(tmp_path / "src")).cache()
    cache = ParseCache(spark, str(tmp_path / "cache"), "1", RECORDS)
    hits, missing = cache.split(files)
    assert hits.count() == 0 and missing.count() == 5
    every = records_of(files).cache()
    cache.store(missing, records_of(missing))
    hits, missing = cache.split(files)
    assert missing.count() == 0 and sorted(map(str, hits.select(*every.columns).collect())) == sorted(map(str, every.collect()))
    assert ParseCache(spark, str(tmp_path / "cache"), "2", RECORDS).split(files)[1].count() == 5  # another version
    sizes = sorted(r.bytes for r in cache.entries().collect())
    kept = cache.evict(sum(sizes) - 1)
    assert 0 < kept.count() < 5 and cache.split(files)[1].count() == 5 - kept.count()
    for f in (tmp_path / "cache").glob("v-*/records/*.parquet"):
        f.unlink()
    assert cache.split(files)[1].count() == 5 - cache.entries().filter("n_records = 0").count()  # a store that lost its records knows no file that had some
    odd = spark.createDataFrame([("a.js", bytearray(b"f(\xff];"))], "path string, content binary")
    assert sorted((r.code, r.start_byte) for r in diagnostics_of(odd).collect()) == [("invalid-utf8", 2), ("missing-syntax", 1), ("syntax-error", 5)]


def test_contract_fields(spark):
    span = ("a.ts", 1, 1, 1, 9)
    rows = {
        "exact": ([("source", "preserves", "q", None, False, span), ("sink", "preserves", None, "os", False, span)], "exact"), "role": ([("source", "preserves", "q", None, False, span), ("guard", "preserves", None, "os", False, span)], "no_match"),
        "kind": ([("source", "preserves", "body", None, False, span), ("sink", "preserves", None, "os", False, span)], "no_match"), "place": ([("source", "preserves", "q", None, False, ("./a.ts", 1, 1, 2, 1)), ("sink", "preserves", None, "os", False, span)], "exact"),
        "far": ([("source", "preserves", "q", None, False, ("a.ts", 1, 1, 9, 1)), ("sink", "preserves", None, "os", False, span)], "no_match"), "file": ([("source", "preserves", "q", None, False, ("../a.ts", 1, 1, 1, 9)), ("sink", "preserves", None, "os", False, span)], "no_match"),
    }
    step = "array<struct<role:string,effect:string,source_kind:string,sink_kind:string,skippable:boolean,span:struct<file:string,start_line:int,start_column:int,end_line:int,end_column:int>>>"
    frame = spark.createDataFrame([(k, rows["exact"][0], o, [True], []) for k, (o, _) in rows.items()], f"k string, e {step}, o {step}, c array<boolean>, b array<string>")
    fields = ("role", "effect", "source_kind", "sink_kind", "span")
    got = {r.k: r.v for r in frame.select("k", reports.contract_verdict(F.col("e"), F.col("o"), F.col("c"), F.col("b"), F.lit(False), fields, F.lit(True)).alias("v")).collect()}
    assert got == {k: v for k, (_, v) in rows.items()}
    other = frame.filter("k = 'exact'").select(reports.contract_verdict(F.col("e"), F.col("o"), F.col("c"), F.col("b"), F.lit(False), fields, F.lit(False)).alias("v")).first()
    assert other.v == "no_match"


def test_previews_and_settings(spark):
    import hashlib

    import pytest

    from corvane.functions.settings import Settings

    text = "\n".join(f"line {i}" for i in range(1, 600))
    row = spark.createDataFrame([(text, "x" * ((1 << 20) + 1))], "t string, big string").select(reports.preview(F.col("t"), F.lit(300), 1000).alias("a"), reports.preview(F.col("big"), F.lit(1)).alias("b"), reports.preview(F.col("t"), F.lit(1), 1).alias("c")).first()
    assert len(row.a) == 401 and row.a[0] == "line 100" and row.b is None and row.c == ["line 1", "line 2"]
    content = "é = exec(x)".encode()
    part = hashlib.sha256(content[5:9]).hexdigest()
    found = spark.createDataFrame([(bytearray(content), 5, 9, part), (bytearray(content), 6, 10, part), (bytearray(content), 5, 99, part)], "c binary, a long, b long, d string").select(reports.verified_span(F.col("c"), F.col("a"), F.col("b"), F.col("d")).alias("s")).collect()
    assert [r.s for r in found] == ["exec", None, None]
    for wrong in ({"max_files": 0}, {"max_depth": 2000}, {"suppressions": (("SE1001", "/abs", 1, "reason given"),)}, {"suppressions": (("SE1001", "a", 1, ""),)}, {"max_errors": 1001}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    assert Settings(suppressions=(("SE1001", "a.ts", 1, "reviewed twice"),)).max_depth is None
