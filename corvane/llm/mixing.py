"""Mixing sources to target weights, in DataFrame functions alone.

Words are counted and summed by source (partial sums first, so a hot source is no hot task). The targets come from those few rows: the
weights share the mix's size, no target passes `ceiling` times its source's size, and what is over goes to the other sources by weight.
In the order of size/weight the sources that reach their ceiling come first, so one running sum solves the resharing. A document is then
emitted floor(rate) times, and once more if a hash, as a number from 0 to 1, falls below the rate's fraction. The hash is of the document's
identifier, source and text, and of its number among the documents that are alike in all three, so every document has its own draw.

Documents alike are found by counting keys. Only where there are any, these rows are written with the task that read them, numbered within
a task, and moved up by what earlier tasks have: no key's rows meet in one task.

Defined cases: a null text has no words; a null source is a source, last in order; documents of a source without words have rate 0 and
are not emitted; a null identifier is one like any other; repeated rows are documents of their own with draws of their own; an empty
table gives no rows. Extra columns stay, those with the names of computed ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, table

WEIGHTS, SHARE, CEILING = (5, 2, 1), 1.5, 2
COMPUTED = ("size", "source_size", "target", "rate", "copies", "taken", "__key", "__ordinal", "__part", "__row", "__before", "__first")


def word_count(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++"))).cast("long")


def draw(key: Column, seed: str = "") -> Column:
    """A number from 0 to 1 that depends on the key alone; 52 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def document_key(key: Column, source: Column, text: Column) -> Column:
    """A digest of identifier, source and text; a null is none of the values, a null text an empty one."""
    known = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(known(key), F.lit("|"), known(source), F.lit("|"), F.md5(F.coalesce(text, F.lit("")))))


def with_ordinals(rows: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with __ordinal: the number, from 1, among those of an equal __key. keys: the __key of each row."""
    repeated = keys.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__key")
    repeated = scratch.keep(repeated, "repeated")
    if repeated.isEmpty():
        return rows.withColumn("__ordinal", F.lit(1).cast("long"))
    alike = rows.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    alike = scratch.keep(alike.join(repeated, "__key", "left_semi"), "alike")
    here = Window.partitionBy("__part", "__key")
    stretches = alike.groupBy("__part", "__key").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    before = stretches.select("__part", "__key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    order = alike.select("__part", "__key", "__row", F.row_number().over(here.orderBy("__row")).alias("__first")).join(before, ["__part", "__key"])
    numbers = order.select("__part", "__row", (F.col("__first") + F.col("__before")).alias("__ordinal"))
    numbered = alike.join(numbers, ["__part", "__row"]).select(*rows.columns, "__ordinal")
    alone = rows.join(repeated, "__key", "left_anti").withColumn("__ordinal", F.lit(1).cast("long"))
    return alone.unionByName(numbered)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """A row a source with its size -> its target. Windows over all rows: there is one row a source, not one a document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_ceiling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, everything = by_ceiling.rowsBetween(Window.unboundedPreceding, -1), by_ceiling.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    shared = weighed.withColumn("level", level)
    # From the first source on that its ceiling doesn't hold down, all share one level.
    found = shared.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= ceiling * F.col("source_size"), F.col("level")), ignorenulls=True).over(everything_ordered(by_ceiling)))
    target = F.least((ceiling * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), (ceiling * F.col("source_size")).cast("double")))
    return found.select("source", "source_size", target.alias("target"))


def everything_ordered(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def plan_mix(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = "", keep_text: bool = True, **how) -> DataFrame:
    """The frame with size, source_size, target, rate, copies and taken. Without `keep_text` the text goes, and words are counted once."""
    scratch = Scratch(frame.sparkSession, "mix")
    own = [c for c in frame.columns if c not in COMPUTED]
    rows = frame.select(*own, word_count(F.col(text_column)).alias("size"), document_key(F.col(id_column), F.col(source_column), F.col(text_column)).alias("__key"))
    if not keep_text:
        rows = scratch.keep(rows.drop(text_column), "sizes")
    narrow = rows if not keep_text else scratch.keep(rows.select(F.col(source_column).alias("source"), "size", "__key"), "sizes")
    totals = narrow.select(F.col("source" if keep_text else source_column).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, **how).withColumnRenamed("source", "__source")
    ceiling = how.get("ceiling", CEILING)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(0.0)
    once_more = draw(F.concat("__key", F.lit("|"), F.col("__ordinal").cast("string")), seed) < F.col("rate") - F.floor("rate")
    numbered = with_ordinals(rows, narrow, scratch)
    joined = numbered.join(targets, numbered[source_column].eqNullSafe(F.col("__source")), "left").drop("__source")
    planned = joined.withColumn("rate", rate).withColumn("copies", (F.floor("rate") + F.when(once_more, 1).otherwise(0)).cast("int"))
    return planned.withColumn("taken", F.col("size") * F.col("copies")).drop("__key", "__ordinal")


def mix_documents(frame: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the frame's own columns."""
    own = frame.select(*[F.col(c).alias(f"__own_{c}") for c in frame.columns], *[F.col(how.get(f"{x}_column", d)).alias(d) for x, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))])
    mixed = plan_mix(own, **{k: v for k, v in how.items() if not k.endswith("_column")}).filter("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"__own_{c}").alias(c) for c in frame.columns])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan_mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce('+' || CAST(doc_id AS VARCHAR), '-') || '|' || coalesce('+' || source, '-') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key) AS ordinal FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(2 * coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
level AS (SELECT level FROM levels WHERE level * weight <= 2 * source_size ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT w.source, w.source_size, least(CAST(2 * w.source_size AS DOUBLE), coalesce(l.level * w.weight, CAST(2 * w.source_size AS DOUBLE))) AS target
  FROM weighed w LEFT JOIN level l ON true),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5(s.key || '|' || s.ordinal), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM numbered s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
