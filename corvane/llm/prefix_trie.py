"""The prefix trie of conversations, by prefix-doubling names.

Equal turns (role and text) get equal numbers, then pairs of neighbouring blocks of 1, 2, 4, ... turns do, round by round: a block that
begins at a multiple of its length is named by the names of its halves. A prefix of d turns is the blocks of d's binary digits, longest
first; from the longest blocks down, a prefix is named by the name of the prefix before its last block and by that block. Each prefix is
named once, in a logarithmic number of joins. Prefixes of one depth and name are a node. Sums over subtrees double as well: after round k a
node holds what lies less than 2^k below it.

Names are numbers from 0 without gaps: names of a hash bucket are numbered in order, after those of the buckets before it, so they are the
same whenever they are made again. Turns are numbered by a sort of all rows in ranges, not in one task a conversation, and the identifiers
that end at a node are joined to texts of bounded length before one task hashes them in their order.

Defined cases: turns without conversation take no part; a null turn number comes first, turns of one number follow role, then text; a null
role or text is an empty one; repeated rows are turns of their own; an empty table gives no nodes; extra columns don't take part.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import Scratch, table

#: Hash buckets in which names are numbered; identifiers in one piece of a node's list.
BUCKETS, PIECE = 1024, 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def dense_names(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """rows with `name`: equal keys have equal numbers, from 0 without gaps."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")
    order = Window.partitionBy("bucket").orderBy(*keys)
    known = scratch.keep(rows.select(*keys).distinct().select(*keys, bucket).withColumn("row", F.row_number().over(order)), "names")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    named = known.join(F.broadcast(offsets), "bucket").select(*keys, (F.col("row") - 1 + F.col("offset")).alias("name"))
    return rows.join(named, keys)


def ordered_turns(conversations: DataFrame, scratch: Scratch, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """A table of conv_id, position (from 0), content (a digest of role and text) and n_bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = conversations.filter(F.col(conv_column).isNotNull()).select(
        F.col(conv_column).alias("conv_id"), F.col(turn_column).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row")
    )
    keys = ["conv_id", "turn", "role", "text", "row"]  # rows that are alike in all the rest may lie in several ranges
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    kept = scratch.keep(ranged.select("conv_id", "place", F.shiftright("place", 33).alias("part"), content.alias("content"), F.octet_length("text").cast("long").alias("n_bytes")), "ranged")
    stretches = kept.groupBy("part", "conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    stretches = stretches.select("part", "conv_id", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return kept.join(stretches, ["part", "conv_id"]).select("conv_id", (F.col("place") - F.col("first") + F.col("before")).alias("position"), "content", "n_bytes")


def _names_of_blocks(turns: DataFrame, most: int, scratch: Scratch) -> list[DataFrame]:
    """For each power of two up to `most` turns: conv_id, position, name of the blocks of that length that begin at its multiples."""
    level = scratch.keep(dense_names(turns.select("conv_id", "position", "content"), ["content"], scratch).select("conv_id", "position", "name"), "blocks")
    levels, width = [level], 1
    while 2 * width <= most:
        left = level.filter(F.col("position") % (2 * width) == 0).withColumnRenamed("name", "left")
        right = level.filter(F.col("position") % (2 * width) == width).select("conv_id", (F.col("position") - width).alias("position"), F.col("name").alias("right"))
        pairs = left.join(right, ["conv_id", "position"])
        level = scratch.keep(dense_names(pairs, ["left", "right"], scratch).select("conv_id", "position", "name"), "blocks")
        levels.append(level)
        width *= 2
    return levels


def _names_of_prefixes(levels: list[DataFrame], lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, name of all prefixes, the empty ones included."""
    made = [lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))]
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        last = levels[k].filter(F.col("position") % (2 * width) == 0).withColumnRenamed("name", "block")
        before = reduce(DataFrame.unionByName, made).filter(F.col("depth") % (2 * width) == 0).select("conv_id", F.col("depth").alias("position"), F.col("name").alias("before"))
        longer = last.join(before, ["conv_id", "position"]).select("conv_id", (F.col("position") + width).alias("depth"), "before", "block")
        made.append(scratch.keep(dense_names(longer, ["depth", "before", "block"], scratch).select("conv_id", "depth", "name"), "prefixes"))
    return reduce(DataFrame.unionByName, made)


def _in_batches(rows, names: list[str], size: int = 1 << 20):
    """Rows -> record batches of about so many characters of text."""
    held, used = [], 0
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=names)
    for row in rows:
        held.append(row)
        used += 64 + len(row[-1])
        if used >= size:
            yield pack()
            held, used = [], 0
    if held:
        yield pack()


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pieces(batches):
    """Sorted (depth, name, conv_id) -> pieces of a node's list: depth, name, first identifier, identifiers joined by commas."""

    def made():
        node, ids = None, []
        for depth, name, conv in _rows(batches):
            if ids and (node != (depth, name) or len(ids) == PIECE):
                yield *node, ids[0], ",".join(map(str, ids))
                ids = []
            node = depth, name
            ids.append(conv)
        if ids:
            yield *node, ids[0], ",".join(map(str, ids))

    return _in_batches(made(), ["depth", "name", "first", "ids"])


def _hash_pieces(batches):
    """Sorted pieces -> depth, name, SHA-256 of the whole list; no list is held."""

    def made():
        node, digest = None, None
        for depth, name, ids in _rows(batches):
            if node == (depth, name):
                digest.update(b",")
            else:
                if node:
                    yield *node, digest.hexdigest()
                node, digest = (depth, name), hashlib.sha256()
            digest.update(ids.encode())
        if node:
            yield *node, digest.hexdigest()

    return _in_batches(made(), ["depth", "name", "ends_sha256"])


def ends_of_nodes(prefixes: DataFrame, lengths: DataFrame) -> DataFrame:
    """depth, name, ends_sha256 of the nodes at which conversations end."""
    ends = prefixes.join(lengths.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select("depth", "name", "conv_id")
    kind = dict((f.name, f.dataType.simpleString()) for f in ends.schema)
    keys = ["depth", "name", "conv_id"]
    pieces = ends.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_pieces, f"depth long, name long, first {kind['conv_id']}, ids string")
    return pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "first").select("depth", "name", "ids").mapInArrow(_hash_pieces, "depth long, name long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """turns: conv_id, position (from 0 without gaps), content, n_bytes; lengths: conv_id, n_turns, one row a conversation -> one row a node:
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = scratch or Scratch(turns.sparkSession, "trie")
    most = lengths.agg(F.max("n_turns")).first()[0] or 0
    levels = _names_of_blocks(turns, most, scratch) if most else []
    prefixes = _names_of_prefixes(levels, lengths, scratch)
    nodes = prefixes.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    last = turns.select("conv_id", (F.col("position") + 1).alias("depth"), "n_bytes")
    nodes = scratch.keep(nodes.join(last, ["conv_id", "depth"], "left"), "nodes")

    def above(rows: DataFrame, distance: int) -> DataFrame:
        """The rows' nodes -> those that lie so far above them."""
        place = prefixes.select("conv_id", (F.col("depth") + distance).alias("depth"), F.col("name").alias("upper"))
        return rows.filter(F.col("depth") >= distance).join(place, ["conv_id", "depth"])

    parents = scratch.keep(above(nodes.select("conv_id", "depth", "name"), 1), "parents")
    children = parents.groupBy((F.col("depth") - 1).alias("depth"), F.col("upper").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    state = nodes.join(children, ["depth", "name"], "left").select(
        "depth", "name", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0).cast("long"))).alias("saved_tokens"),
    )
    state, distance = scratch.keep(state, "state"), 1
    while distance <= most:
        lower = above(state.select("conv_id", "depth", "n_leaves", "saved_tokens"), distance)
        sums = lower.groupBy((F.col("depth") - distance).alias("depth"), F.col("upper").alias("name")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        none = F.lit(0).cast("long")
        grown = state.join(sums, ["depth", "name"], "left").select(
            "depth", "name", "conv_id", "n_convs", "n_children",
            (F.col("n_leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", none)).alias("saved_tokens"),
        )
        state, distance = scratch.keep(grown, "state"), 2 * distance
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("upper"), F.col("conv_id").alias("parent_conv_id"))
    named = parents.select("depth", "name", "upper").join(upper, ["depth", "upper"]).select("depth", "name", "parent_conv_id")
    found = state.join(named, ["depth", "name"], "left").join(ends_of_nodes(prefixes, lengths), ["depth", "name"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def share_heads(turns: DataFrame, scratch: Scratch, family: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of the family's first conversation, then each one's own turns after its first h -> turns and lengths.

    h is the crc32 of the identifier modulo `spread`; families are `family` identifiers that follow one another.
    """
    sizes = scratch.keep(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")), "sizes")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    plan = sizes.select("conv_id", "n_own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(base, "base", "left")
    plan = scratch.keep(plan.select("conv_id", "base", "h", "n_own", F.least("h", F.coalesce("n_base", F.lit(0))).cast("long").alias("shared")), "plan")
    own = turns.join(plan, "conv_id").filter("position >= h").select("conv_id", (F.col("position") - F.col("h") + F.col("shared")).alias("position"), "content", "n_bytes")
    heads = turns.filter(F.col("position") < spread).withColumnRenamed("conv_id", "base")  # at most so many rows, for at most `family` members
    shared = plan.select("conv_id", "base", "h").join(heads, "base").filter("position < h").select("conv_id", "position", "content", "n_bytes")
    lengths = plan.select("conv_id", (F.col("shared") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return scratch.keep(shared.unionByName(own), "rebuilt"), lengths


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns = scratch.keep(ordered_turns(table(spark, sf_dir, "conversations"), scratch), "turns")
    return prefix_trie(*share_heads(turns, scratch), scratch)


ORACLE = """
WITH crc AS (
  SELECT list(list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384::UBIGINT, a >> 1) ELSE a >> 1 END) ORDER BY i) AS entries
  FROM range(256) AS r(i)),
ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS position
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, n,
    CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
      lambda a, b: xor(a >> 8, entries[CAST(xor(a, b) & 255 AS BIGINT) + 1]))) % 9 AS BIGINT) AS h
  FROM (SELECT conv_id, count(*) AS n FROM ordered GROUP BY conv_id), crc),
plan AS (SELECT s.*, least(s.h, coalesce(b.n, 0)) AS shared FROM sizes s LEFT JOIN sizes b ON s.base = b.conv_id),
rebuilt AS (
  SELECT p.conv_id, o.position, o.role, o.text FROM plan p JOIN ordered o ON o.conv_id = p.base WHERE o.position < p.h
  UNION ALL
  SELECT o.conv_id, o.position - p.h + p.shared, o.role, o.text FROM plan p JOIN ordered o USING (conv_id) WHERE o.position >= p.h),
prefixes AS (
  SELECT conv_id, position + 1 AS depth, strlen(text) AS n_bytes, list(sha256(strlen(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY position) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM plan),
nodes AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CAST(e.conv_id AS VARCHAR), ',' ORDER BY e.conv_id), '')) AS ends_sha256
  FROM prefixes p LEFT JOIN plan e ON e.conv_id = p.conv_id AND e.shared + greatest(e.n - e.h, 0) = p.depth
  GROUP BY p.depth, p.path),
children AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.depth = c.depth AND n.path = c.path),
sums AS (
  SELECT a AS depth, path[:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved_tokens
  FROM counted, range(0, depth + 1) AS r(a) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON n.depth = s.depth AND n.path = s.path LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]
"""
