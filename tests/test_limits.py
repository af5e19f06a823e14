import pytest
from pyspark.sql import functions as F

from corvane.functions.settings import Settings
from corvane.plans.fixpoint import RECORDS
from corvane.plans.report import REACHED, SCANNER_VERSION, scan_report
from corvane.plans.scanner import LANGUAGE, Text
from corvane.sources.cache import ParseCache


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Eight files, each with a flow, a bracket too many and some facts; four more are over the size limit."""
    place = tmp_path_factory.mktemp("limits")
    for i in range(8):
        (place / f"f{i}.ts").write_text(f"import {{ exec }} from 'child_process';\nexport function h{i}(req) {{\n  const v = req.query.q;\n  exec(v);\n}}\nfetch(process.env.A);\n)\n")
    for i in range(4):
        (place / f"large{i}.ts").write_text("x" * 3000)
    return str(place)


def codes(report):
    return {r.code for r in report.limitations.collect()} & set(REACHED)


def test_nothing_is_marked_within_the_limits(spark, folder):
    report = scan_report(spark, folder, Settings(max_file_bytes=2000))
    assert codes(report) == set() and report.findings.count() == 8 and report.diagnostics.count() == 8 and report.errors.count() == 4
    assert report.facts.count() > 16 and report.graph[0].count() > 16 and report.graph[1].count() > 16


def test_each_limit_acts_and_says_so(spark, folder):
    tight = scan_report(spark, folder, Settings(max_file_bytes=2000, max_findings=3, max_parser_diagnostics=2, max_facts_per_file=2, max_total_facts=11, max_graph_edges=7, max_errors=3))
    assert codes(tight) == {"finding-limit-reached", "candidate-limit-reached", "diagnostic-limit-reached", "fact-limit-reached", "graph-limit-reached", "error-limit-reached"}
    assert tight.findings.count() == 3 and tight.diagnostics.count() == 2
    assert tight.facts.count() == 11 and tight.facts.groupBy("path").count().agg(F.max("count")).first()[0] == 2
    assert tight.graph[1].count() == 7 and tight.errors.count() == 3
    assert [r.code for r in tight.errors.orderBy("path").collect()].count("error-limit-reached") == 1
    few = scan_report(spark, folder, Settings(max_file_bytes=2000, max_graph_nodes=9, max_graph_edges=2))
    assert {"record-limit-reached", "graph-limit-reached"} <= codes(few)
    assert few.records.count() == 9 and few.graph[0].count() == 9 and few.findings.count() <= 2
    again = scan_report(spark, folder, Settings(max_file_bytes=2000, max_findings=3))
    assert sorted(r.finding_id for r in again.findings.collect()) == sorted(r.finding_id for r in tight.findings.collect())  # the same ones stay


def test_the_cache_keeps_its_size(spark, folder, tmp_path):
    store = str(tmp_path / "cache")
    first = scan_report(spark, folder, Settings(max_file_bytes=2000), cache=store)
    size = first.files.filter("content IS NOT NULL").agg(F.max("size_bytes")).first()[0]
    scan_report(spark, folder, Settings(max_file_bytes=2000, max_cache_bytes=3 * size), cache=store)
    kept = ParseCache(spark, store, SCANNER_VERSION, RECORDS).entries()
    assert 1 <= kept.count() <= 3 and kept.agg(F.sum("bytes")).first()[0] <= 3 * size
    assert scan_report(spark, folder, Settings(max_file_bytes=2000), cache=store).findings.count() == 8
    assert ParseCache(spark, store, SCANNER_VERSION, RECORDS).entries().count() == 8


def test_a_division_far_from_its_operand():
    text = Text("a" + " " * 500 + "/ b / c; x = /re[/]g/;", LANGUAGE["javascript"])
    assert "/ b / c" in text.text and "re[" not in text.text
