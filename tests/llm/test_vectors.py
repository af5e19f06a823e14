import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm.approximate_search import Quantiser, approximate_neighbours, op10_approximate_neighbours
from corvane.llm.exact_search import ORACLE, exact_top_k, op4_exact_top_k
from tests.llm.compare import duck, same
from tests.llm.conftest import SF

ODD = [(1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (50, [0.0, 0.0])]


def test_exact_equals_sql(spark):
    assert same(op4_exact_top_k(spark, SF), duck(SF), ORACLE) == 50


def brute(rows, chosen, k, integer):
    fine = [(i, np.array(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and (integer or any(v))]
    queries = {}
    for i, v in sorted(fine, key=lambda r: r[1].tolist(), reverse=True):
        if i is not None and i % chosen == 0:
            queries[i] = v
    out = []
    for q, a in queries.items():
        scored = sorted((-float((np.floor(256 * a) * np.floor(256 * b)).sum() if integer else (a * b).sum()), i is None, i or 0) for i, b in fine if i != q and len(a) == len(b))
        out += [(q, r + 1, None if n else i, -s) for r, (s, n, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def rows_of(found):
    return sorted(((r.query_id, r.rank, r.vec_id, float(r.score)) for r in found.collect()), key=str)


def test_edges_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = ODD + [(i, [0.5, 0.25]) for i in range(100, 700)] + [(i, rng.normal(size=2).tolist()) for i in range(1000, 1400)]
    rows += [(1200, [9.0, -9.0]), (1200, [0.25, 8.0]), (None, [0.5, 0.25]), (None, None), (150, [1.0, 2.0, -1.0]), (7, [3.0, 1.0, 1.0]), (None, [3.0, 1.0, 1.0]), (250, []), (8, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert rows_of(exact_top_k(frame, F.col("vec_id") % 50 == 0)) == brute(rows, 50, 5, True)
    near, want = rows_of(approximate_neighbours(frame, F.col("vec_id") % 20 == 0, probes=10_000)), brute(rows, 20, 20, False)
    assert [r[:3] for r in near] == [r[:3] for r in want] and np.allclose([r[3] for r in near], [r[3] for r in want], atol=1e-12)
    for search in (exact_top_k, approximate_neighbours):
        assert search(frame.limit(0), F.col("vec_id") % 2 == 0).count() == 0
        assert search(frame.filter("vec_id IN (100, 101, 102)"), F.col("vec_id") % 2 == 0).count() == 4


def test_sql_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = ODD + [(i, rng.normal(size=2).tolist()) for i in range(100, 160)] + [(150, [1.0, 1.0, 4.0]), (None, [3.0, 1.0, 1.0])]
    connection = duckdb.connect()
    connection.register("f", pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [r[1] for r in rows]}))
    connection.sql("CREATE TABLE embeddings AS SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM f")
    assert same(exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0), connection, ORACLE)


def test_large_integers(spark):
    frame = spark.createDataFrame([(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [3e5, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in exact_top_k(frame, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, (256 * 300000) ** 2 + 256 * 768), (1, (256 * 300000) ** 2 + 256 * 512)]


def recall(points, ids, got, modulus, k=20):
    hits = total = 0
    for q in np.flatnonzero(ids % modulus == 0):
        score = points @ points[q]
        score[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(-score)[:k]].tolist()))
        total += k
    return hits / total


def neighbours(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


@pytest.mark.parametrize("spread", [0.35, 0.1])
def test_recall_with_few_of_many_cells_in_any_layout(spark, spread):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(300, 16))
    points = (centres[rng.integers(0, 300, 40_000)] + spread * rng.normal(size=(40_000, 16))).round(6)
    ids = np.arange(40_000)
    frame = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), 16).cast(pa.list_(pa.float64()))}))
    model = Quantiser.fit(points[:20_000], 200, 20)
    assert len(model.centroids) == 200 and model.probes <= 60  # well under half of them
    chosen = F.col("vec_id") % 400 == 0
    small = neighbours(approximate_neighbours(frame, chosen, sample_bytes=8 * 16 * 9000))  # the sample is a part of the rows
    assert recall(points, ids, small, 400) >= 0.9
    found = approximate_neighbours(frame.repartition(3), chosen)
    assert recall(points, ids, neighbours(found), 400) >= 0.9
    assert rows_of(found) == rows_of(approximate_neighbours(frame.repartition(8), chosen))


def test_recall_of_the_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toArrow()
    ids, points = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    assert recall(points, ids, neighbours(op10_approximate_neighbours(spark, "/root/testdata/sf0.1")), 20) >= 0.9


def test_codes_bound_the_error():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 10))
    model = Quantiser.fit(points, 20, 20)
    cells, codes, left = model.encode(points)
    query = rng.normal(size=10)
    words = np.einsum("js,jws->jw", Quantiser.parts(query[None])[0], model.words)
    guess = model.centroids[cells] @ query + words[np.arange(codes.shape[1]), codes].sum(axis=1)
    assert (np.abs(points @ query - guess) <= np.sqrt(query @ query) * left + 1e-9).all()
