"""The corpus pipeline: stages over documents, each written and read again before the next one.

quality (classifier): documents predicted 0 go. language: documents whose language is unknown, or is not the one they claim, go.
near_duplicates: one document of each group stays (five words a shingle, similarity 0.8). mixing: each document as often as its source's
target asks for. packing: the sequences' pieces.

Rows without identifier are scored and identified like any other and have no duplicates; of rows that share one, the row of the least
hash stays after near_duplicates, whatever the order they are read in. Every stage takes an empty table and gives one. A stage's table is
deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.language import UNKNOWN, identify_language, learn_profiles
from corvane.llm.mixing import mix_documents
from corvane.llm.near_duplicates import near_duplicates
from corvane.llm.packing import pack_documents
from corvane.llm.quality import score_quality
from corvane.llm.shared import Scratch, fold, table


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as no column of the documents has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return tuple(found)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score, predicted = unused(docs, "__score", "__predicted")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), columns=docs.columns, names=(score, predicted))
    return scored.filter(F.col(predicted) == 1).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = unused(docs, "__lang", "__score")
    profiles = learn_profiles(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = identify_language(docs, profiles, columns=docs.columns, names=(lang, score))
    fits = (F.col(lang) != UNKNOWN) & F.coalesce(F.col("lang") == F.col(lang), F.lit(True))
    return found.filter(fits).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_duplicates(docs, width=5).filter("NOT kept").select("doc_id").distinct()
    left = docs.join(groups.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    again = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    if again.isEmpty():
        return left
    row = F.struct(*left.columns)
    named = left.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64(*left.columns), F.col("text"))).alias("row")).select("row.*")
    return named.unionByName(left.filter("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicate), ("mixing", mixing), ("packing", packing)]

#: The stages train models, sketch and pack; SQL can't say that. Tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop_others(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
