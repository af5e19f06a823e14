"""Joins that Spark has no word for, as compositions of those it has.

Every one is an equality join or a window on the entity first, so it is dealt by that key and sorts inside it. Ranges become equalities
too: a span goes to the one or two cells of its own size class that it touches, a point to one cell of each class, so a hot entity is
spread over its cells and a point meets only spans of nearly its place. Nulls match nothing, on either side, and rows keep their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.windows import carried_forward, summed_upto


def same_row(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in columns])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], strict: bool = True, tie: str | None = None, hot: bool | None = None) -> DataFrame:
    """left with the `values` of the latest right row of the same key before (or, if not strict, at) its own place; nulls without one.

    One shuffle: both sides go by the key in one union, and the last right row is carried forward. `tie` orders right rows at one place.
    Keys too large for a task are found by their counts and cut into slices (hot: see windows.by_size).
    """
    ties = F.col(tie) if tie else F.lit(0)
    # At equal places a right row stands after left ones if strict, before them if not.
    marked = right.filter(F.col(key).isNotNull()).select(F.col(key), F.col(at), F.lit(1 if strict else -1).alias("__side"), ties.alias("__tie"), F.struct(*values).alias("__value"), F.lit(None).cast(left.schema.simpleString()).alias("__row"))
    rows = left.select(F.col(key), F.col(at), F.lit(0).alias("__side"), F.lit(0).alias("__tie"), F.lit(None).cast(marked.schema["__value"].dataType).alias("__value"), F.struct(*left.columns).alias("__row"))
    carried = carried_forward(rows.unionByName(marked), key, [at, "__side", "__tie"], {"__last": F.col("__value")}, hot)
    return carried.filter(F.col("__row").isNotNull()).select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def _size_class(start: Column, end: Column) -> Column:
    """The least class whose cells (of 2 ** class places) are as long as the span, so that it touches at most two."""
    return F.ceil(F.log2((end - start + 1).cast("double"))).cast("int")


def _cell(place: Column, size_class: Column) -> Column:
    return F.floor(place / F.pow(F.lit(2.0), size_class)).cast("long")


def in_spans(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and a span of its key that holds its place (whole numbers), both ends included: columns of both, the span's start and end as they are.

    A point is sent to one cell of each class that spans of its key have (64 at most); points of keys without spans go nowhere.
    """
    sized = spans.filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end))).withColumn("__class", _size_class(F.col(start), F.col(end)))
    used = sized.groupBy(F.col(key).alias("__own")).agg(F.collect_set("__class").alias("__classes"))
    ends = F.array_distinct(F.array(_cell(F.col(start), F.col("__class")), _cell(F.col(end), F.col("__class"))))
    celled = sized.withColumn("__cell", F.explode(ends)).withColumnRenamed(key, "__key")
    sent = points.join(used, F.col(key) == F.col("__own")).withColumn("__c", F.explode("__classes")).drop("__own", "__classes").withColumn("__x", _cell(F.col(at), F.col("__c")))
    hit = (F.col(key) == F.col("__key")) & (F.col("__c") == F.col("__class")) & (F.col("__x") == F.col("__cell")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    return sent.join(celled, hit).drop("__key", "__c", "__x", "__class", "__cell")


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, result: str) -> DataFrame:
    """points with the `result` of the smallest span of the same key that contains them; of equal ones the first to start, then the least result; null without one."""
    own = spans.select(F.col(key), F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(result).alias("__result"))
    span = F.struct((F.col("__end") - F.col("__start")).alias("size"), "__start", F.col("__result").alias("result"))
    places = points.select(key, at).distinct()  # one answer a place, whatever else the rows hold
    found = in_spans(places, own, key, at, "__start", "__end").groupBy(key, at).agg(F.min(span).alias("__span")).select(key, at, F.col("__span.result").alias(result))
    return points.join(found, [key, at], "left").select(*points.columns, result)


def dominated(points: DataFrame, guards: DataFrame, key: str, at: str, start: str, end: str, kind: str = "left_semi") -> DataFrame:
    """Points that a guard's range covers (left_semi), or that none does (left_anti)."""
    spans = guards.select(F.col(key), F.col(start).alias("__start"), F.col(end).alias("__end"))
    covered = in_spans(points.select(key, at).distinct(), spans, key, at, "__start", "__end").select(key, at).distinct()
    return points.join(covered, [key, at], kind).select(*points.columns)


def _owners(name: Column) -> Column:
    """What a name is a member of: `a` and `a.b` of `a.b[0]`."""
    places = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)).isin(".", "["))
    return F.when(F.length(name) > 0, F.transform(places, lambda i: F.substring(name, F.lit(1), i - 1))).otherwise(F.array().cast("array<string>"))


def redefined_between(ranges: DataFrame, definitions: DataFrame, key: str, start: str, end: str, at: str, value: str | None = None, output: str | None = None, receiver: str | None = None, hot: bool | None = None) -> DataFrame:
    """Ranges within which (both ends left out) a definition of the same key lies; with names, one of the value itself, of a member, of its owner, or a call on it as receiver.

    A range asks for the first definition after its start alone, so no pair of a range and a definition is ever made. Names are equality
    keys: a definition goes by its own name and those it is a member of, a range by its value, and by those the value is a member of.
    """
    names = [x for x in (value,) if x]
    wanted = ranges.select(key, start, end, *names).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (key, start, end, *names))).distinct()
    made = definitions.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    if value:
        own, v = [F.filter(F.array(*[F.col(x) for x in (output, receiver) if x] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())], F.col(value)
        kinds = F.transform(F.array_distinct(own[0]), lambda n: F.struct(F.lit(0).alias("kind"), n.alias("name")))
        asked = F.array(F.struct(F.lit(0).alias("kind"), v.alias("name")))
        if output:
            o = F.col(output)
            owners = F.when(o.isNotNull(), F.concat(F.transform(_owners(o), lambda n: F.struct(F.lit(0).alias("kind"), n.alias("name"))), F.array(F.struct(F.lit(1).alias("kind"), o.alias("name")))))
            kinds = F.concat(kinds, F.coalesce(owners, F.array().cast("array<struct<kind:int,name:string>>")))
            asked = F.concat(asked, F.transform(_owners(v), lambda n: F.struct(F.lit(1).alias("kind"), n.alias("name"))))
        made, asking = made.withColumn("__name", F.explode(F.array_distinct(kinds))), wanted.withColumn("__name", F.explode(F.array_distinct(asked)))
    else:
        made, asking = made.withColumn("__name", F.lit(0)), wanted.withColumn("__name", F.lit(0))
    # The latest place before the start, counted backwards, is the first one after it.
    turned = made.select(F.struct(F.col(key).alias("key"), F.col("__name").alias("name")).alias("__key"), (-F.col(at)).alias("__at"), F.col(at).alias("__first"))
    left = asking.select(F.struct(F.col(key).alias("key"), F.col("__name").alias("name")).alias("__key"), (-F.col(start)).alias("__at"), *wanted.columns)
    on = [key, start, end, *names]
    found = as_of(left, turned, "__key", "__at", ["__first"], hot=hot).filter(F.col("__first") < F.col(end)).select(*on).distinct()
    return ranges.join(found, on, "left_semi").select(*ranges.columns)


def unique_match(calls: DataFrame, targets: DataFrame, name: str, scope: str, result: str) -> DataFrame:
    """calls with the one target of that name in their own scope; else the one of that name anywhere; else null. Several are none."""
    own = targets.groupBy(name, scope).agg(F.count("*").alias("n"), F.min(result).alias("own")).filter("n = 1").drop("n")
    anywhere = targets.groupBy(name).agg(F.count("*").alias("n"), F.min(result).alias("anywhere")).filter("n = 1").drop("n")
    tier = F.when(F.col("own").isNotNull(), "own").when(F.col("anywhere").isNotNull(), "anywhere").otherwise("none")
    several = targets.select(name, scope).distinct().withColumn("__has", F.lit(True))  # several in the own scope hide all others
    joined = calls.join(own, [name, scope], "left").join(several, [name, scope], "left").join(anywhere, name, "left")
    joined = joined.withColumn("anywhere", F.when(F.col("__has").isNull(), F.col("anywhere")))
    return joined.withColumn("tier", tier).withColumn(result, F.coalesce("own", "anywhere")).drop("own", "anywhere", "__has")


def longest_prefix(rows: DataFrame, known: DataFrame, name: str, prefix: str, separator: str = "/") -> DataFrame:
    """rows with the longest known prefix that ends at a separator (or is the whole name); null without one. Prefixes become equality keys."""
    parts = F.split(name, f"\\Q{separator}\\E")
    names = rows.select(name).distinct()
    exploded = names.withColumn("__n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn(prefix, F.array_join(F.slice(parts, F.lit(1), F.col("__n")), separator))
    best = exploded.join(known.select(prefix).distinct(), prefix).groupBy(name).agg(F.max_by(prefix, "__n").alias(prefix))
    return rows.join(best, name, "left").select(*rows.columns, prefix)


def positional(left: DataFrame, right: DataFrame, key: str, order: str, hot: bool | None = None) -> DataFrame:
    """The n-th row of a key on the left beside its n-th on the right: (key, place, left, right) as structs; inner."""
    def placed(frame: DataFrame, side: str) -> DataFrame:
        numbered = summed_upto(frame, [key], [order], {"__place": F.lit(1)}, hot)
        return numbered.select(key, F.col("__place").cast("int").alias("place"), F.struct(*[c for c in frame.columns if c != key]).alias(side))

    return placed(left, "left").join(placed(right, "right"), [key, "place"])


def unstable(rows: DataFrame, earlier: DataFrame, key: str, at: str) -> DataFrame:
    """Rows without an earlier binding of the same key."""
    first = earlier.groupBy(F.col(key).alias("__key")).agg(F.min(at).alias("__first"))
    return rows.join(first, (F.col(key) == F.col("__key")) & (F.col("__first") < F.col(at)), "left_anti")


def compare_snapshots(current: DataFrame, baseline: DataFrame, fingerprint: str = "fingerprint", related: str = "related_key") -> DataFrame:
    """state, fingerprint, related_key: unchanged by fingerprint; changed by related key; else new; baseline rows that meet neither are resolved."""
    now, then = current.select(fingerprint, related).distinct(), baseline.select(fingerprint, related).distinct()
    prints = then.select(F.col(fingerprint).alias("__f")).distinct()
    keys = then.select(F.col(related).alias("__k")).distinct()
    judged = now.join(prints, F.col(fingerprint) == F.col("__f"), "left").join(keys, F.col(related) == F.col("__k"), "left")
    state = F.when(F.col("__f").isNotNull(), "unchanged").when(F.col("__k").isNotNull(), "changed").otherwise("new")
    gone = then.join(now.select(F.col(fingerprint)).distinct(), fingerprint, "left_anti").join(now.select(F.col(related)).distinct(), related, "left_anti")
    return judged.select(state.alias("state"), fingerprint, related).unionByName(gone.select(F.lit("resolved").alias("state"), fingerprint, related))


def apply_suppressions(findings: DataFrame, suppressions: DataFrame, on: list[str], order: str, rules: list[str]) -> tuple[DataFrame, DataFrame]:
    """(findings left, a diagnostic a suppression): applied, stale, invalid-rule, invalid-scope, invalid-reason. Each takes away its first match alone."""
    code = F.when(~F.coalesce(F.col("rule_id").isin(*rules), F.lit(False)), "invalid-rule").when(F.col("path").rlike(r"(^|/)\.\.(/|$)|[*?]") | (F.trim("path") == ""), "invalid-scope").when(F.octet_length(F.trim("reason")) < 8, "invalid-reason")
    judged = suppressions.withColumn("code", code)
    valid = judged.filter(F.col("code").isNull()).select(*on).distinct()
    first = findings.join(valid, on, "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy(order))).filter("__n = 1")
    left = findings.join(first.select(order), order, "left_anti")
    hit = first.select(*on).withColumn("__hit", F.lit(True))
    diagnostics = judged.join(hit, on, "left").withColumn("code", F.coalesce("code", F.when(F.col("__hit"), "applied").otherwise("stale"))).drop("__hit")
    return left, diagnostics
