"""Findings as a table: filter, order, explain, baseline rows, suppression, assessment links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ascii_lower, cost_bound, redacted

#: How severities and confidences rank, the highest first.
SEVERITY = ["critical", "high", "medium", "low", "informational"]
CONFIDENCE = ["high", "medium", "low"]
SEARCHED = ("finding_id", "rule_id", "severity", "confidence", "category", "path", "function", "source_path", "message", "title")


def rank(column: Column, order: list[str]) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), column), F.lit(0)).cast("int")


def matching(findings: DataFrame, text: str | None = None, **parts: str) -> DataFrame:
    """Rows whose named columns contain the given parts, whatever their case; and `text` in any searched column."""
    out = findings
    for name, part in parts.items():
        out = out.filter(F.contains(ascii_lower(F.col(name).cast("string")), F.lit(part.lower())))
    if text:
        hit = F.lit(False)
        for name in (x for x in SEARCHED if x in findings.columns):
            hit = hit | F.coalesce(F.contains(ascii_lower(F.col(name).cast("string")), F.lit(text.lower())), F.lit(False))
        if "trail" in findings.columns:
            hit = hit | F.coalesce(F.exists("trail", lambda step: F.contains(ascii_lower(step.cast("string")), F.lit(text.lower()))), F.lit(False))
        out = out.filter(hit)
    return out


def order_of(by: str = "severity") -> list[Column]:
    """severity and confidence (the highest first, unknown ones last), rule, file, category; equal ones by identifier."""
    def ranked(name: str, order: list[str]) -> Column:
        return F.when(rank(F.col(name), order) == 0, 99).otherwise(rank(F.col(name), order))

    first = {"severity": [ranked("severity", SEVERITY)], "confidence": [ranked("confidence", CONFIDENCE)], "rule": [F.col("rule_id")], "file": [F.col("path"), F.col("sink_start")], "category": [F.col("category")]}
    return [*first[by], F.col("finding_id")]


def ordered(findings: DataFrame, by: str = "severity") -> DataFrame:
    return findings.orderBy(*order_of(by))


def first_of(findings: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows with their place, and whether there are more."""
    head = findings.orderBy(*order).limit(keep + 1)
    placed = head.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of at most keep + 1 rows
    return placed.withColumn("truncated", F.max("place").over(Window.partitionBy()) > keep).filter(F.col("place") <= keep)


def explain(findings: DataFrame, finding_id: str) -> DataFrame:
    return findings.filter(F.col("finding_id") == finding_id).limit(1)


def baseline_rows(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint", "related_key").distinct()


def assessment_preview(findings: DataFrame, source: Column, input_price: int = 0, output_price: int = 0, output_tokens: int = 512) -> DataFrame:
    """What would be sent for a finding: its source with secrets hidden, a hash to consent to, and the cost's bound. Nothing is sent."""
    shown = redacted(source)
    tokens = F.ceil(F.octet_length(shown["text"]) / 3)
    return findings.select("finding_id", shown["text"].alias("payload"), shown["hidden"].alias("hidden"), F.sha2(F.concat_ws("\x00", "finding_id", shown["text"]), 256).alias("consent"), cost_bound(tokens, F.lit(output_tokens), input_price, output_price).alias("cost_bound"))


def attach_assessments(findings: DataFrame, assessments: DataFrame, strict: bool = False) -> DataFrame:
    """findings with the assessment of the same identifier and fingerprint. One that only shares the identifier is a mismatch, and one without a finding is none; strict: both are errors."""
    known = assessments.select("finding_id", F.col("fingerprint").alias("__print"), "verdict")
    if strict:
        bad = known.join(findings.select("finding_id", "fingerprint"), "finding_id", "left").filter(~F.coalesce(F.col("__print") == F.col("fingerprint"), F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"assessment of {bad[0].finding_id} does not belong to these findings")
    joined = findings.join(known, "finding_id", "left")
    return joined.withColumn("verdict", F.when(F.col("__print").isNull(), F.lit(None)).when(F.col("__print") == F.col("fingerprint"), F.col("verdict")).otherwise("mismatch")).drop("__print")


def assessment_property(verdict: Column) -> Column:
    """What a finding's exchange document says of its assessment, in JSON; nothing of a mismatch."""
    return F.when(verdict.isNotNull() & (verdict != "mismatch"), F.to_json(F.struct(F.struct(verdict.alias("verdict")).alias("assessment")))).otherwise("{}")
