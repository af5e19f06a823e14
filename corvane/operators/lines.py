"""Places in texts: every occurrence of a string, and the line and column of each, by one table of lines a file instead of a prefix a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.joins import as_of
from corvane.operators.windows import summed_upto


def pieces(rows: DataFrame, key: str, text: str, separator: str, hot: bool | None = None) -> DataFrame:
    """key, n (from 0), start (byte), piece: what stands between the separators of each text, which are taken from the left without overlap. Keys name one text each; null texts and keys have none."""
    cut_up = rows.filter(F.col(key).isNotNull()).select(key, F.posexplode(F.split(text, f"\\Q{separator}\\E", -1)).alias("n", "piece"))
    size = F.octet_length("piece") + len(separator.encode())
    return summed_upto(cut_up, [key], ["n"], {"__end": size}, hot).select(key, "n", (F.col("__end") - size).alias("start"), "piece")


def occurrences(rows: DataFrame, key: str, text: str, needle: str, hot: bool | None = None) -> DataFrame:
    """key, at: the byte where each occurrence begins."""
    return pieces(rows, key, text, needle, hot).filter("n > 0").select(key, (F.col("start") - len(needle.encode())).alias("at"))


def located(matches: DataFrame, files: DataFrame, key: str, at: str, text: str, hot: bool | None = None) -> DataFrame:
    """matches with line and column (code points), both from 1, of the byte `at` of their file; nulls where there is no such file or place."""
    lines = pieces(files, key, text, "\n", hot).select(key, F.col("start").alias(at), F.struct((F.col("n") + 1).alias("number"), "start", "piece").alias("__line"))
    found = as_of(matches, lines.select(key, at, "__line"), key, at, ["__line"], strict=False, hot=hot)
    line, own = F.col("__line"), F.col(at) - F.col("__line.start")
    before = F.substring(line.piece.cast("binary"), F.lit(1), own.cast("int"))
    there = F.when((F.col(at) >= 0) & (own <= F.octet_length(line.piece)), line.number)
    return found.withColumns({"line": there, "column": F.when(there.isNotNull(), F.length(before.cast("string")) + 1)}).drop("__line")
