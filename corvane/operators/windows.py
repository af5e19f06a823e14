"""Ordered computations: budgets, retention, segments, neighbours. Those over a whole table prune to the rows that matter before they sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lineage import cut

#: Rows of one key that a task sorts; keys that have more are cut into slices of their order.
TASK_ROWS = 1 << 22
#: Slices of an order for each shuffle partition of the session, so that tasks that get several are even.
SLICES = 2


def by_size(rows: DataFrame, keys: list[str], hot: bool | None, whole: Callable[[DataFrame], DataFrame], split: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """whole(rows of keys that a task can sort) and split(rows of those with more than TASK_ROWS); null is a key like any other.

    hot: None counts the keys' rows first, in a pass over the keys alone; True and False say that all are large, or none.
    """
    if hot is None:
        own = F.struct(*keys)
        counted = rows.groupBy(*keys).count().filter(F.col("count") > TASK_ROWS).select(own.alias("__large"))
        hot = False
        if not counted.isEmpty():
            large = cut(counted)  # a row for TASK_ROWS rows at most
            return whole(rows.join(large, own == F.col("__large"), "left_anti")).unionByName(split(rows.join(large, own == F.col("__large"), "left_semi")))
    return split(rows) if hot else whole(rows)


def previous_edges(rows: DataFrame, entity: str, order: list[str], node: str, hot: bool | None = None) -> DataFrame:
    """(entity, from_node, to_node): each row of an entity after the one before it; rows without entity have none."""
    placed = rows.filter(F.col(entity).isNotNull()).select(*dict.fromkeys([entity, *order, node]))
    before = carried_forward(placed, entity, order, {"__before": F.struct(F.col(node).alias("node"))}, hot)
    return before.select(entity, F.col("__before.node").alias("from_node"), F.col(node).alias("to_node")).filter(F.col("from_node").isNotNull())


#: Kinds of records that no flow of control passes through, or that have no node.
OUTSIDE_FLOW = ["function", "handler", "argument", "source", "import", "authorization-candidate", "control-gate"]


def in_control_flow(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("kind").isin(*OUTSIDE_FLOW))


def segments(rows: DataFrame, entity: str, order: str, marker: Column, name: str = "segment", hot: bool | None = None) -> DataFrame:
    """rows with the number of markers up to and with them, among the rows of their entity."""
    return summed_upto(rows, [entity], [order], {name: F.when(marker, 1).otherwise(0)}, hot)


def summed_upto(rows: DataFrame, keys: list[str], order: list[str], sizes: dict[str, Column], hot: bool | None = None) -> DataFrame:
    """rows with, for each name, the sum over the rows of the same keys up to and with them; rows that are equal in the order stand in any one."""
    def whole(part: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return part.withColumns({name: F.sum(size).over(upto) for name, size in sizes.items()})

    def split(part: DataFrame) -> DataFrame:
        own = {f"__s{i}": size for i, size in enumerate(sizes.values())}
        cut_up = sliced(part.withColumns({**own, "__group": F.struct(*keys)}), [*keys, *order])
        sums = cut_up.groupBy("__slice", "__group").agg(*[F.sum(s).alias(s) for s in own])
        earlier = Window.partitionBy("__group").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
        handed = sums.select("__slice", "__group", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in own])
        within = Window.partitionBy("__slice", "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        joined = cut_up.withColumns({f"{s}_own": F.sum(s).over(within) for s in own}).join(handed, ["__slice", "__group"])
        return joined.select(*part.columns, *[(F.col(f"{s}_own") + F.col(f"{s}_before")).alias(name) for s, name in zip(own, sizes, strict=True)])

    return by_size(rows, keys, hot, whole, split)


def sliced(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __slice: consecutive ranges of the order, SLICES for each shuffle partition at most. Nulls stand first.

    Only the order's columns are shuffled to find the ranges, and only their ends are written down, a row a slice, so that all readers see the
    same slices; the rows themselves are numbered as they are read. Rows that are equal in the whole order are in one slice. Readers compute
    `rows` again, so a costly or random one is to be cut first.
    """
    most = SLICES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ranges = rows.select(place.alias("end")).repartitionByRange(most, "end")
    ends = cut(ranges.groupBy(F.spark_partition_id().alias("n")).agg(F.max("end").alias("end")).select("end").coalesce(1))
    marked = rows.withColumns({"__ends": ends.agg(F.array_sort(F.collect_list("end"))).scalar(), "__place": place, "__slice": F.lit(0)})
    for step in (1 << i for i in reversed(range(most.bit_length()))):  # how many ends are less than the place, by halving
        further = F.col("__slice") + step
        marked = marked.withColumn("__slice", F.when(F.try_element_at("__ends", further) < F.col("__place"), further).otherwise(F.col("__slice")))
    return marked.drop("__ends", "__place")


def running_total(rows: DataFrame, order: list[str], size: Column, name: str) -> DataFrame:
    """Exact sums over the whole table in order, without one task that sees all rows."""
    return running_totals(rows, order, {name: size})


def running_totals(rows: DataFrame, order: list[str], sizes: dict[str, Column]) -> DataFrame:
    """Several sums in one order: slices are summed, then rows within slices.

    The slices' sums are a row a slice; rows are sorted inside their own.
    """
    own = sliced(rows.withColumns({f"__size{i}": size for i, size in enumerate(sizes.values())}), order)
    sums = own.groupBy("__slice").agg(*[F.sum(f"__size{i}").alias(f"__sum{i}") for i in range(len(sizes))])
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__slice", *[F.coalesce(F.sum(f"__sum{i}").over(earlier), F.lit(0)).alias(f"__before{i}") for i in range(len(sizes))])
    within = Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(F.broadcast(before), "__slice").withColumns({name: F.col(f"__before{i}") + F.sum(f"__size{i}").over(within) for i, name in enumerate(sizes)})
    return placed.drop("__slice", *[f"__{what}{i}" for what in ("size", "before") for i in range(len(sizes))])


def carried_forward(rows: DataFrame, key: str, order: list[str], values: dict[str, Column], hot: bool | None = None) -> DataFrame:
    """rows with, for each name, the last value that is not null among the rows before of the same key.

    One shuffle by the key and one sort within it. Keys too large for a task (see by_size) are cut into slices of the order of (key, order),
    and what a slice's first key had before comes from a row a slice and key.
    """
    def whole(part: DataFrame) -> DataFrame:
        before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumns({name: F.last(value, ignorenulls=True).over(before) for name, value in values.items()})

    def split(part: DataFrame) -> DataFrame:
        own = {f"__v{i}": value for i, value in enumerate(values.values())}
        cut_up = sliced(part.withColumns({**own, "__group": F.struct(key)}), [key, *order])
        place = F.struct(*order)
        lasts = cut_up.groupBy("__slice", "__group").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(v) for v in own])
        several = lasts.withColumn("__n", F.count("*").over(Window.partitionBy("__group"))).filter("__n > 1")
        earlier = Window.partitionBy("__group").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        handed = several.select("__slice", "__group", *[F.last(v, ignorenulls=True).over(earlier).alias(f"{v}_before") for v in own])
        within = Window.partitionBy("__slice", "__group").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        joined = cut_up.withColumns({f"{v}_own": F.last(v, ignorenulls=True).over(within) for v in own}).join(handed, ["__slice", "__group"], "left")
        return joined.select(*part.columns, *[F.coalesce(f"{v}_own", f"{v}_before").alias(name) for v, name in zip(own, values, strict=True)])

    return by_size(rows, [key], hot, whole, split)


def previous_in_order(rows: DataFrame, order: list[str], columns: list[str], prefix: str = "previous_") -> DataFrame:
    """rows with columns of the row before, over the whole table: inside slices by `lag`, and at a slice's start from the last row of the slice before it."""
    own = sliced(rows, order)
    sort = Window.partitionBy("__slice").orderBy(*order)
    fields = F.struct(*columns)
    lasts = own.groupBy("__slice").agg(F.max(F.struct(F.struct(*order).alias("at"), fields.alias("row"))).alias("__last"))
    handed = lasts.select("__slice", F.lag("__last.row").over(Window.orderBy("__slice")).alias("__handed"))  # a row a slice
    lagged = own.withColumn("__before", F.lag(fields).over(sort)).join(F.broadcast(handed), "__slice")
    before = F.coalesce("__before", "__handed")
    return lagged.select(*rows.columns, *[before[c].alias(f"{prefix}{c}") for c in columns])


def byte_budget(rows: DataFrame, order: list[str], size: str, largest: int, budget: int) -> DataFrame:
    """rows with verdict: too-large before all else; then in order admitted until the first that would pass the budget; everything after is over-budget."""
    fits = F.col(size) <= largest
    total = running_total(rows, order, F.when(fits, F.col(size)).otherwise(0), "total")
    # Sums only grow, so the first row over the budget and all after it are the rows whose sum is over it.
    return total.withColumn("verdict", F.when(~fits, "too-large").when(F.col("total") > budget, "over-budget").otherwise("admitted"))


def newest_within(rows: DataFrame, order: list[Column], size: str, budget: int) -> DataFrame:
    """What stays when the oldest go until the rest is within the budget. The sum runs from the newest on."""
    names = [f"__o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, order, strict=True)))
    return running_total(keyed, names, F.col(size), "__total").filter(F.col("__total") <= budget).drop("__total", *names)


def newest(rows: DataFrame, entity: str, order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows of each entity in that order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(entity).orderBy(*order))).filter(F.col("__n") <= keep).drop("__n")


def capped(rows: DataFrame, group: str, order: list[str], each: int, overall: int) -> DataFrame:
    """At most `each` rows a group, then the first `overall` of what is left in the order of (group, order)."""
    return newest(rows, group, [F.col(c) for c in order], each).orderBy(group, *order).limit(overall)


def bounded_facts(facts: DataFrame, file: str, order: list[str], each: int, overall: int) -> tuple[DataFrame, DataFrame]:
    """(facts within both caps, a diagnostic for each file that had more than `each`)."""
    cut_off = facts.groupBy(file).count().filter(F.col("count") > each).select(file, F.lit("fact-limit-reached").alias("code"))
    return capped(facts, file, order, each, overall), cut_off


def adjacent_distinct(rows: DataFrame, order: list[str], keys: list[str], within: str | None = None) -> DataFrame:
    """Rows none of whose keys equals that of the row before; nulls equal nothing. Only neighbours are compared, as in a sorted list that is walked once; with `within`, only neighbours that agree there."""
    order = [*([within] if within else []), *order]
    before = previous_in_order(rows, order, [*keys, *([within] if within else [])], "__before_")
    same = F.lit(False)
    for key in keys:
        same = same | F.coalesce(F.col(key) == F.col(f"__before_{key}"), F.lit(False))
    if within:
        same = same & F.col(within).eqNullSafe(F.col(f"__before_{within}"))
    return before.filter(~same).select(*rows.columns)


def out_of_order(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """Rows (in the order they claim) whose key is not greater than that of the row before: none, in a strictly ascending list."""
    return previous_in_order(rows, order, [key], "previous_").filter(F.col("previous_" + key) >= F.col(key))


def definitions_before(uses: DataFrame, definitions: DataFrame, key: list[str], at: str, name: str = "definitions", hot: bool | None = None) -> DataFrame:
    """uses with how many definitions of the same key stand before their place. One union, a running count a key; at one place uses stand first."""
    marks = uses.select(*key, F.col(at), F.struct(*uses.columns).alias("__row"), F.lit(0).alias("__one"))
    more = definitions.filter(" AND ".join(f"{k} IS NOT NULL" for k in key)).select(*key, F.col(at), F.lit(None).cast(marks.schema["__row"].dataType).alias("__row"), F.lit(1).alias("__one"))
    counted = summed_upto(marks.unionByName(more), key, [at, "__one"], {"__n": F.col("__one")}, hot)
    return counted.filter("__row IS NOT NULL").select("__row.*", F.col("__n").cast("long").alias(name))


def with_limit(rows: DataFrame, order: list, keep: int, sentinel: dict) -> DataFrame:
    """The first `keep` rows; where there are more, the sentinel row stands in the place of the last one, so that a cut list says so."""
    first = rows.orderBy(*order).limit(keep + 1)
    place = first.withColumn("__place", F.row_number().over(Window.orderBy(*order)))  # of at most keep + 1 rows
    cut_off = F.max("__place").over(Window.partitionBy()) > keep
    marked = place.withColumn("__cut", cut_off).filter(F.col("__place") <= keep)
    last = F.col("__cut") & (F.col("__place") == keep)
    return marked.select(*[F.when(last, F.lit(sentinel.get(c)).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in rows.columns])
