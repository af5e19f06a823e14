"""Untrusted values in ordered records: the relational form over event streams, and the record-level fixed point in plans.fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.windows import carried_forward


def tainted_at_sinks(events: DataFrame, entity: str, order: list[str], source: Column, kill: Column, clean: Column, sink: Column, hot: bool | None = None) -> DataFrame:
    """Sinks with the place of the source they are reached from: the last source, after the last kill, with nothing cleaning in between.

    One shuffle and one sort a key, which carry the places forward; entities too large for a task are cut into slices (hot: see windows.by_size).
    """
    place = F.struct(*order)
    marked = carried_forward(events, entity, order, {"__source": F.when(source, place), "__kill": F.when(kill, place), "__clean": F.when(clean, place)}, hot)
    alive = F.col("__source").isNotNull() & F.coalesce(F.col("__source") > F.col("__kill"), F.lit(True)) & F.coalesce(F.col("__source") > F.col("__clean"), F.lit(True))
    return marked.filter(sink & alive).withColumns({f"source_{c}": F.col(f"__source.{c}") for c in order}).drop("__source", "__kill", "__clean")
