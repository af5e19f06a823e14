from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_mixing import targets_by_rounds
from tests.llm.test_near_duplicates import brute_force

SF = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = tmp_path / name
        before, docs_before = docs.columns, docs
        stage(spark, docs, SF).write.parquet(str(kept[name]))
        docs = spark.read.parquet(str(kept[name]))
        if name != "packing":
            assert docs.columns == before
        kept[name] = docs_before, docs
    before, after = [Counter(r.doc_id for r in x.collect()) for x in kept["quality"]]
    wrong = [d for d, q in labels.items() if d in before and (d in after) != (q == 1)]
    assert len(wrong) <= 0.01 * len(labels)
    before, after = kept["language"]
    assert after.count() >= 0.98 * before.count()
    before, after = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r in brute_force(rows, 5) if r[3])
    before, after = kept["mixing"]
    size, got = Counter(), Counter()
    for r in before.collect():
        size[r.source] += len(r.text.split())
    for r in after.collect():
        got[r.source] += len(r.text.split())
    want = targets_by_rounds(size)
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.05
    before, after = kept["packing"]
    own = [(i, r.text) for i, r in enumerate(before.collect())]
    total = sum(r.length for r in after.collect())
    assert after.select("sequence_id").distinct().count() <= total / 2048 * 1.02 + 2
    assert after.filter("piece = 0").count() == len(own)


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "x", 0), (1, "", "en", "x", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, odd, SF).columns == odd.columns
    assert stages["language"](spark, odd, SF).count() == 0  # none has a letter
    assert sorted(map(str, stages["near_duplicates"](spark, odd, SF).select("doc_id").toPandas()["doc_id"].tolist())) == ["1.0", "nan"]
    assert stages["mixing"](spark, odd, SF).count() == 0  # no words, rate 0
    assert stages["packing"](spark, odd, SF).agg(F.count("*"), F.sum("length"), F.countDistinct("sequence_id")).first() == (3, 3, 1)


def test_one_row_an_identifier_in_any_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.limit(40).collect()
    again = [(r.doc_id, r.text + " twice " * k, r.lang, f"s{k}", r.n_chars) for r in rows for k in range(3)]
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    found = [sorted(map(tuple, stage(spark, spark.createDataFrame(some, docs.schema).repartition(n), SF).collect())) for some, n in ((again, 2), (again[::-1], 5))]
    assert found[0] == found[1] and len({r[0] for r in found[0]}) == len(found[0]) > 30


#: Names that the stages and their operators give to columns of their own.
OWN_NAMES = [f"doc_id AS {c}" for c in ("__score", "__Predicted", "__lang", "___lang", "__source", "__copy", "__own_doc_id", "__key", "__ordinal", "__part", "__row", "__before", "__first", "row", "count", "high", "low", "rate", "taken", "source_size", "held_out")]


def test_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = docs.limit(60).selectExpr("*", "doc_id AS size", "doc_id AS score", "lang AS target", "doc_id AS predicted", "doc_id AS copies", "text AS lang_pred", "doc_id AS kept", "doc_id AS n", "doc_id AS piece", *OWN_NAMES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, SF)
        assert after.columns == clash.columns and 0 < after.count() == after.filter("size = doc_id AND score = doc_id AND kept = doc_id").count()
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, clash, SF)
    assert packed.filter("piece = 0").count() == 60 and packed.columns == dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).columns


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
