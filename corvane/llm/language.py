"""Language identification by rank-order profiles.

A profile lists a language's most frequent n-grams (one to three letters, words padded by a space) in order. A document's own most
frequent n-grams are compared with each profile: the out-of-place distance adds up how far each stands from its place there, and
the full penalty where it is missing. Counts cover all training documents: tasks count distinct words by language, then their n-grams,
and the sums are partial before the shuffle; only the heads of the profiles reach the driver. Prediction is one pass over whole texts.

Defined cases: a null text or one without letters is `und` with score 0; so is every text when nothing can be learned; documents of a
null language are not learned from; equal counts rank by n-gram, equal distances by language; a null identifier counts as an empty
text for its fold; repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import arrow_schema, ddl, fold, split_batches, table, whole_texts

UNKNOWN = "und"
PROFILE, OWN = 400, 300
#: Counts that a task holds before it hands them on.
HELD = 1 << 20


def letters_alone(texts: pa.Array) -> pa.Array:
    """Lower-cased, with one space in place of everything that is no letter, and one at either end."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.binary_join_element_wise(" ", whole_texts(texts).cast(pa.string()), " ", "")), r"[^\pL]+", " ")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a text of letters and single spaces (21 bits a character), and where each starts. None has a space inside, nor is one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = codes != 32
    at = np.arange(len(codes))
    one, two = codes[letter], (codes[:-1] << 21 | codes[1:])
    real_two, real_three = letter[:-1] | letter[1:], letter[1:-1]
    three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[real_three]
    return np.concatenate([one, two[real_two], three]), np.concatenate([at[letter], at[:-1][real_two], at[:-2][real_three]])


def _count(kind: T.StructType):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], schema=arrow_schema(kind))
            held.clear()

        for batch in split_batches(batches, 16384):
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang))
                words = pc.value_counts(pc.split_pattern(letters_alone(own.column(1)), " ").flatten())
                words = words.filter(pc.not_equal(words.field("values"), ""))
                if not len(words):
                    continue
                text = f" {' '.join(words.field('values').to_pylist())} "
                found, start = grams(text)
                inside = np.cumsum(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32) - 1  # a space belongs to the word after it
                weight = words.field("counts").to_numpy()[inside[start]]
                gram, index = np.unique(found, return_inverse=True)
                n = np.bincount(index, weights=weight, minlength=len(gram)).astype(np.int64)
                if lang in held:
                    both, index = np.unique(np.concatenate([held[lang][0], gram]), return_inverse=True)
                    gram, n = both, np.bincount(index, weights=np.concatenate([held[lang][1], n]), minlength=len(both)).astype(np.int64)
                held[lang] = (gram, n)
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield from out()
        yield from out()

    return count


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its most frequent n-grams in order, from documents (lang, text)."""
    kind = ddl("lang string, gram long, n long")
    counts = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), "text").mapInArrow(_count(kind), kind)
    totals = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # `size` rows a language
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(p, np.int64) for lang, p in profiles.items()}


def identify_language(docs: DataFrame, profiles: dict[str, np.ndarray], columns: list[str] | None = None, own_size: int = OWN, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The named columns of the documents (doc_id without any) with lang_pred and score, or as `names` call them (1 at no distance, 0 at the full penalty)."""
    keep = columns or ["doc_id"]
    known = sorted(profiles)
    every = np.unique(np.concatenate([profiles[x] for x in known])) if known else np.zeros(0, np.int64)
    longest = max([len(p) for p in profiles.values()], default=1)
    places = np.full((len(every) + 1, len(known)), -1, np.int64)  # the last row is of n-grams in no profile
    for k, x in enumerate(known):
        places[np.searchsorted(every, profiles[x]), k] = np.arange(len(profiles[x]))
    model = docs.sparkSession.sparkContext.broadcast((known, every, places, longest))
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    at = source.columns.index("text")
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, every, places, longest = model.value
        for batch in split_batches(batches, 4096):
            found, scores = [], []
            for text in letters_alone(batch.column(at)).to_pylist():
                gram, n = np.unique(grams(text)[0], return_counts=True)
                if not len(gram) or not langs:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                order = np.lexsort((gram, -n))[:own_size]
                row = np.searchsorted(every, gram[order])
                place = places[np.where(every[np.minimum(row, len(every) - 1)] == gram[order], row, len(every))]
                distance = np.where(place < 0, longest, np.abs(place - np.arange(len(order))[:, None])).sum(axis=0)
                best = int(distance.argmin())
                found.append(langs[best])
                scores.append(1 - float(distance[best]) / (longest * len(order)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], schema=arrow_schema(schema))

    return source.mapInArrow(identify, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    profiles = learn_profiles(docs.filter(~held))
    return identify_language(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
