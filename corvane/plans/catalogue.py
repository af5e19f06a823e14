"""All queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import analysis, evidence, facts, fixpoint, flows, frontend, inventory, names, relations, report
from corvane.plans.registry import ORACLES, QUERIES

MODULES = (inventory, names, relations, analysis, evidence, fixpoint, flows, frontend, facts, report)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks that an untrusted source reaches, under their rule."""
    return QUERIES["taint_events"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
