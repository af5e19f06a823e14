from pyspark.sql import functions as F

from corvane.llm import quality


def test_fits_on_twenty_thousand_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append(len(rows)))
    docs = spark.range(26_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    assert seen == [20_000]
