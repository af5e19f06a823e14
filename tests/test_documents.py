import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from corvane.plans.fixpoint import EXAMPLE, RECORDS, candidates, findings
from corvane.sources import documents, reports
from tests.compare import rows_of


@pytest.fixture(scope="module")
def many(spark):
    """A finding, copied 5000 times under other identifiers, dealt badly."""
    one = findings(candidates(spark.createDataFrame(EXAMPLE, RECORDS))).first()
    frame = spark.createDataFrame([one], reports.FINDING).crossJoin(spark.range(5000))
    return frame.withColumn("finding_id", F.sha2(F.col("id").cast("string"), 256)).withColumn("path", F.concat("path", F.lit("\n , é"), "id")).drop("id").repartition(7)


@pytest.fixture
def several_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def staged(spark):
    from corvane.operators.lineage import shared_folder

    _, folder = documents.place_of(shared_folder(spark))
    return [x for x in os.listdir(folder) if x.startswith("document-")]


def test_one_document(spark, many, tmp_path, several_parts):
    assert reports.export_json(many, str(tmp_path / "r.json")) == 5000
    document = json.loads((tmp_path / "r.json").read_text())
    assert (document["complete"], document["total"]) == (True, 5000)
    ids = [f["finding_id"] for f in document["findings"]]
    assert ids == sorted(ids) and len(set(ids)) == 5000
    assert rows_of(reports.read_report(spark, str(tmp_path / "r.json"))) == rows_of(many)
    assert os.listdir(tmp_path) == ["r.json"] and staged(spark) == []
    assert reports.export_sarif(many, str(tmp_path / "r.sarif")) == 5000
    assert len(json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["results"]) == 5000


def test_a_large_document_is_read_in_pieces(spark, many, tmp_path, monkeypatch):
    path = str(tmp_path / "r.json")
    reports.export_json(many, path, header={"left_out": 0, "note": ', "findings": ['})
    monkeypatch.setattr(reports, "MAX_DOCUMENT", 1000)
    assert rows_of(reports.read_report(spark, path)) == rows_of(many)
    text = (tmp_path / "r.json").read_text().split("\n")
    for wrong in (text[:-2], [*text[:5], *text[6:]], ["{}", *text[1:]], [*text[:5], "{oops,", *text[6:]]):
        (tmp_path / "r.json").write_text("\n".join(wrong))
        with pytest.raises(Exception, match="cut off|does not hold|MALFORMED|Malformed"):
            reports.read_report(spark, path).collect()
    reports.export_json(many, path, limit=10)
    with pytest.raises(ValueError, match="not complete"):
        reports.read_report(spark, path)
    assert reports.read_report(spark, path, partial=True).count() == 10


def test_parts(spark, many, tmp_path, several_parts):
    path = tmp_path / "parts"
    for n in (5000, 1):  # the second takes the place of the first
        frame = many if n == 5000 else many.limit(1)
        assert reports.export_json(frame, str(path), parts=True) == n
        manifest = json.loads((path / documents.MANIFEST).read_text())
        names = [p["name"] for p in manifest["parts"]]
        assert manifest["rows"] == n and sorted([*names, documents.MANIFEST]) == sorted(os.listdir(path)) and (len(names) > 1) == (n > 1)
        ids = [f["finding_id"] for name in names for f in json.loads((path / name).read_text())["findings"]]
        assert len(ids) == n and ids == sorted(ids)
    assert rows_of(reports.read_report(spark, str(path))) == rows_of(many.orderBy("finding_id").filter(F.col("finding_id") == ids[0]))
    os.unlink(path / names[0])
    with pytest.raises(OSError):
        reports.read_report(spark, str(path))
    reports.export_sarif(many, str(tmp_path / "sarif"), parts=True)
    (name, *_) = [p["name"] for p in json.loads((tmp_path / "sarif" / documents.MANIFEST).read_text())["parts"]]
    assert json.loads((tmp_path / "sarif" / name).read_text())["version"] == "2.1.0"


def test_no_rows(spark, many, tmp_path):
    for parts in (False, True):
        path = str(tmp_path / f"none{parts}")
        assert reports.export_json(many.limit(0), path, parts=parts) == 0
        assert reports.read_report(spark, path).count() == 0


def test_a_task_that_fails_leaves_nothing(spark, many, tmp_path):
    (tmp_path / "r.json").write_text("before")
    bad = many.withColumn("finding_id", F.when(F.col("path").endswith("4999"), F.raise_error(F.lit("lost"))).otherwise(F.col("finding_id")))
    rows = bad.select("finding_id")
    with pytest.raises(Exception, match="lost"):
        reports._write(rows, str(tmp_path / "r.json"), "[", "]")
    reports.export_json(many.limit(3), str(tmp_path / "p"), parts=True)
    there = sorted(os.listdir(tmp_path / "p"))
    with pytest.raises(Exception, match="lost"):
        reports._write(rows, str(tmp_path / "p"), "[", "]", parts=True)
    assert sorted(os.listdir(tmp_path / "p")) == there
    shutil.rmtree(tmp_path / "p")
    assert os.listdir(tmp_path) == ["r.json"] and (tmp_path / "r.json").read_text() == "before" and staged(spark) == []


def test_attempts_that_were_not_committed_do_not_count(tmp_path):
    """The files of tasks that were tried twice stand beside those that count."""
    writer = documents.DocumentWriter({"path": str(tmp_path / "d"), "staging": str(tmp_path / "s"), "head": "[", "tail": "]"})
    os.makedirs(writer.folder)
    for name, body in {"part-000001-7": '\n"lost"', "part-000001-9": '\n"b"', "part-000000-8": '\n"a"'}.items():
        with open(os.path.join(writer.folder, name), "w") as file:
            file.write(body)
    writer.commit([documents.Part(1, "part-000001-9", 1), None, documents.Part(0, "part-000000-8", 1), documents.Part(2, "part-000002-3", 0)])
    assert json.loads((tmp_path / "d").read_text()) == ["a", "b"] and os.listdir(tmp_path / "s") == []
