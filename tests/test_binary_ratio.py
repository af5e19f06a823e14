from corvane.plans.catalogue import ORACLES, QUERIES
from tests.compare import duck, rows_by_sql, rows_of


def test_long_documents_have_a_row(spark, tmp_path):
    texts = {1: "\x01" * 2048 + "a" * 8000, 2: "a" * 8192 + "\x01" * 9000, 3: "a" + "é" * 5000 + "\x02" * 9000, 4: "\x7f\t\n\r", 5: "", 6: None, 7: "\x01" * 20_000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def percent(text):
        sample = (text or "").encode()[:8192]
        return sum((b < 32 and b not in (9, 10, 12, 13)) or b == 127 for b in sample) * 100 // len(sample) if sample else 0

    got = rows_of(QUERIES["cls_binary_ratio"](spark, str(tmp_path)).select("doc_id", "control_percent"))
    assert got == sorted(((percent(t), k) for k, t in texts.items()), key=str)
    assert got == rows_by_sql(duck(tmp_path), f"SELECT doc_id, control_percent FROM ({ORACLES['cls_binary_ratio']})")[1]
    assert rows_of(QUERIES["cls_binary_ratio"](spark, str(tmp_path))) == rows_by_sql(duck(tmp_path), ORACLES["cls_binary_ratio"])[1]
