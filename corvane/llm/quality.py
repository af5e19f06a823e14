"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed into 2^18 places: words with A-Z in lower case, and runs of one to three token shapes (letters, capitals,
digits and signs with repeats drawn together; a token equal to the one before it has a shape of its own). Indicators are scaled by their
log-count ratio between the classes; a linear model with squared hinge loss is fitted on them by dual coordinate descent; cross-fitted
margins are turned into probabilities by a logistic curve. The model is fitted on the driver from at most SAMPLE labelled rows (those of
the least hash), so its cost and the broadcast weights are bounded; every text is scored whole, in one pass without a shuffle.
A token of more than PIECE characters (a text without white space, say) counts as its successive pieces of that length. A feature that
fewer than LEAST_ROWS sampled rows have is left out of the fit, as its ratio would be chance.

Defined cases: a null text is an empty one, its score is that of no features; labels that are null, or of unknown documents, are left
out; with labels of one class or none every score is their share (0.5 without any); a null identifier counts as an empty text for its
fold; repeated rows are scored alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import CACHE_ENTRIES, arrow_schema, ddl, fold, free_memory, mix64, split_batches, table, whole_texts, worker_state

PLACES = 1 << 18
SAMPLE = 20_000
PIECE = 256
LEAST_ROWS = 3  # a feature that fewer sampled rows have is left out
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0x51ED270B)
_RUNS = re.compile(r"(.)\1+", re.S)


class Shapes:
    """Hashes of a token: of its lower-cased self, and of its shape."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh3_64_intdigest

        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = []
        for w in words:
            if (got := known.get(w)) is None:
                text = w.decode("utf-8", "replace")
                shape = _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in text))
                got = xxh3_64_intdigest(w.lower()), xxh3_64_intdigest(shape.encode())
                if len(w) <= 64:
                    known[w] = got
            out.append(got)
        both = np.array(out, np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _pieces(words: list[bytes], codes: np.ndarray, rows: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The same with each long word as its pieces: distinct words, and each place's word and row."""
    known: dict[bytes, int] = {}
    cut = []
    for w in words:
        text = w.decode("utf-8", "replace") if len(w) > PIECE else ""
        parts = [text[i : i + PIECE].encode() for i in range(0, len(text), PIECE)] if len(text) > PIECE else [w]
        cut.append([known.setdefault(p, len(known)) for p in parts])
    sizes = np.array([len(c) for c in cut])
    starts, times = np.cumsum(sizes) - sizes, sizes[codes]
    inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return list(known), np.concatenate(cut)[np.repeat(starts[codes], times) + inside], np.repeat(rows, times)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row << 18 | place) of all texts, and each row's bounds in them."""
    lists = pc.ascii_split_whitespace(whole_texts(texts))
    coded = lists.flatten().dictionary_encode()
    words = [w or b"" for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    codes = coded.indices.to_numpy()
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if any(len(w) > PIECE for w in words):
        words, codes, rows = _pieces(words, codes, rows)
    own, shape = worker_state(("shapes",), Shapes)(words)
    real = np.array([len(w) > 0 for w in words], bool)[codes] if len(codes) else np.zeros(0, bool)
    codes, rows = codes[real], rows[real]
    with np.errstate(over="ignore"):
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
        one = np.where(again, _AGAIN, shape[codes] if len(codes) else np.zeros(0, np.uint64))
        two = one[:-1] * _MULTIPLIER + one[1:]
        three = two[:-1] * _MULTIPLIER + one[2:]
        grams = [(own[codes], rows)] if len(codes) else []
        grams += [(one, rows), (two[rows[1:] == rows[:-1]], rows[1:][rows[1:] == rows[:-1]]), (three[rows[2:] == rows[:-2]], rows[2:][rows[2:] == rows[:-2]])]
        places = [(r << 18) | (mix64(g + np.uint64(k)) & np.uint64(PLACES - 1)).astype(np.int64) for k, (g, r) in enumerate(grams)]
    # Shapes are few: their duplicates go before the large sort.
    found = np.unique(np.concatenate([places[0] if len(codes) else np.zeros(0, np.int64), *[np.unique(x) for x in places[1:]]]))
    return found, np.searchsorted(found, np.arange(len(texts) + 1) << 18)


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, labels: np.ndarray, cost: float = 1.0, passes: int = 15, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear model with squared hinge loss over rows of indicators scaled by `values`; labels are -1 and 1."""
    weights, alpha, diagonal = np.zeros(len(values) + 1), np.zeros(len(rows)), 0.5 / cost
    scaled = [values[r] for r in rows]
    norms = np.array([v @ v + 1 + diagonal for v in scaled])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            row, value, y = rows[i], scaled[i], labels[i]
            gradient = y * (weights[row] @ value + weights[-1]) - 1 + diagonal * alpha[i]
            if alpha[i] == 0 and gradient >= 0:
                continue
            most = max(most, abs(gradient))
            fresh = max(alpha[i] - gradient / norms[i], 0.0)
            step = (fresh - alpha[i]) * y
            alpha[i] = fresh
            weights[row] += step * value
            weights[-1] += step
        if most < 0.01:
            break
    return weights


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == side] or [np.zeros(0, np.int64)]), minlength=PLACES) for side in (1, -1)]
    p, q = counts[0] + smoothing, counts[1] + smoothing
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[counts[0] + counts[1] < LEAST_ROWS] = 0
    return ratio


def logistic_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """slope, shift: the logistic curve of the margins that fits the labels best; a few steps of Newton's method, slightly damped."""
    x, t = np.column_stack([margins, np.ones(len(margins))]), np.where(labels > 0, 1 - 1 / (2 + (labels > 0).sum()), 1 / (2 + (labels < 0).sum()))
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weight of each place, slope, shift); the bias is in the shift."""

    def one(some: np.ndarray) -> np.ndarray:
        own = [rows[i] for i in some]
        ratio = log_count_ratio(own, labels[some])
        weights = dual_coordinate_descent(own, ratio, labels[some])
        return np.append(weights[:-1] * ratio, weights[-1])

    n = len(rows)
    if not n or abs(labels.sum()) == n:
        share = min(max(float((labels > 0).mean()) if n else 0.5, 0.01), 0.99)
        return np.zeros(PLACES), 1.0, float(np.log(share / (1 - share)))
    part, margins = np.arange(n) % 3, np.zeros(n)
    for k in range(3):
        learn, test = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(test):
            weights = one(learn)
            margins[test] = [weights[rows[i]].sum() + weights[-1] for i in test]
    slope, shift = logistic_fit(margins, labels)
    weights = one(np.arange(n))
    return weights[:-1], slope, slope * weights[-1] + shift


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0) -> tuple[np.ndarray, float, float]:
    """From documents (doc_id, text) and labels (doc_id, quality): the sample is the labelled rows of the least hashes outside the held-out fold."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = ddl("doc_id string, quality int, places binary")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 1024, 4 << 20):
            found, bounds = features(batch.column(2))
            places = [(found[a:b] & (PLACES - 1)).astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary())], schema=arrow_schema(schema))

    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` small rows
    got = own.select(F.col("doc_id").cast("string"), F.col("quality").cast("int"), "text").mapInArrow(extract, schema).groupBy("doc_id", "quality").agg(F.min("places").alias("places")).toArrow().to_pydict()
    order = sorted(range(len(got["doc_id"])), key=lambda i: (got["doc_id"][i], got["places"][i]))
    rows, labels = [np.frombuffer(got["places"][i], "<u4").astype(np.int64) for i in order], np.array([1.0 if got["quality"][i] == 1 else -1.0 for i in order])
    del got
    model = fit(rows, labels)
    del rows
    free_memory()
    return model


def score_quality(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted"), **how) -> DataFrame:
    """The named columns of the documents (doc_id without any) with score and predicted, or as `names` call them."""
    keep = columns or ["doc_id"]
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = source.columns.index("text")
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, shift = model.value
        for batch in split_batches(batches, 1024, 4 << 20):
            found, bounds = features(batch.column(at))
            sums = np.concatenate([[0.0], np.cumsum(weights[found & (PLACES - 1)])])
            out = 1 / (1 + np.exp(-np.clip(slope * (sums[bounds[1:]] - sums[bounds[:-1]]) + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out), pa.array((out >= threshold).astype(np.int32))], schema=arrow_schema(schema))

    return source.mapInArrow(score, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
