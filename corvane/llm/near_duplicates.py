"""MinHash near-duplicates: sets of word shingles, fast similarity sketches, banding, exact verification, components.

A sketch has SKETCH coordinates. In each round every shingle is hashed to one bin with one value, and a bin keeps the least value of the
earliest round that reached it; from round SKETCH on, a round serves one bin alone, so 2 * SKETCH rounds fill every bin of any set. Each
coordinate of two sets agrees with probability near their similarity, with the concentration of independent samples. Bands of
ROWS coordinates give keys; 32 bands of 5 miss a pair of similarity 0.8 with probability 3e-6.

1. Equal sets are one node, named by their smallest identifier (and by the set too where identifiers repeat): exact copies never become pairs.
2. Each node is held against the smallest node of its buckets (one pair a node), on full sets of shingles; links give components.
3. Where a bucket still has several components, nodes outside its largest one are held against a node of that one.
4. What is still apart in a bucket is compared sketch by sketch inside blocks of the bucket: nodes outside the largest component against
   all others. Only (node, other component) leaves a task, where some member's sketch agrees in MAYBE of its coordinates (5 standard
   deviations below 0.8). Each such node then meets the component's members, again in blocks, on full sets. So components are exact up
   to the sketches' chance, and pairs are never listed.

A node that many others are held against (a hub) gets its text once a block of BLOCK of them, so no task sees all of a large group, and
joins that carry identifiers and labels alone are left to adaptive execution, which splits a hot key.

Defined cases: null and blank texts have the empty set and link with nothing; rows without identifier link with nothing, their component
is null and they are kept; rows that share an identifier are one document: each of their sets is a node, those are linked, and all the
rows have one component; an empty table gives no rows; texts of any length are taken whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import Scratch, WordHashes, arrow_schema, ddl, hashed_words, mix64, split_batches, table, worker_state

SKETCH, ROWS = 160, 5
MAYBE = 0.64
BLOCK = 512
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer words than `width`, the whole sequence is one."""
    words, counts = hashed_words(texts, worker_state(("words",), WordHashes))
    n, total = len(words), np.full(max(0, len(words) - width + 1), width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            total = total * _MULTIPLIER + words[k : k + len(total)]
        total = mix64(total)
        out, end = [], 0
        for count in counts.tolist():
            start, end = end, end + count
            if count >= width:
                out.append(np.unique(total[start : end - width + 1]))
            elif count:
                one = np.uint64(count)
                for w in words[start:end]:
                    one = one * _MULTIPLIER + w
                out.append(mix64(np.array([one], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    assert end == n
    return out


def similarity_sketch(values: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Of a set of 64-bit hashes, not empty: `size` values, each its round above 48 bits of hash."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    start, step = 0, max(1, int(1.3 * size * np.log(size) / len(values)))
    while start < 2 * size and out.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(start, min(start + step, 2 * size), dtype=np.uint64)
        with np.errstate(over="ignore"):
            hashed = mix64(values[None, :] ^ mix64(rounds * _MULTIPLIER + np.uint64(1))[:, None])
        bins = (hashed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
        late = rounds >= size
        if late.any():
            bins[late] = (rounds[late] - np.uint64(size))[:, None]
        np.minimum.at(out, bins.ravel().astype(np.int64), (rounds[:, None] << np.uint64(48) | mix64(hashed) >> np.uint64(16)).ravel())
        start, step = start + step, max(1, step // 2)
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    bands = sketches.reshape(len(sketches), -1, ROWS)
    keys = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mix64(keys * _MULTIPLIER + bands[:, :, k])
    return keys


def set_hash(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        high = np.array([mix64(x).sum(dtype=np.uint64) for x in sets], np.uint64)
        return high.view(np.int64), np.array([mix64(x + _MULTIPLIER).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)


def _sketched(id_type: T.DataType, width: int):
    schema = T.StructType([T.StructField("doc_id", id_type), *ddl("n_shingles long, high long, low long, bands array<long>, sketch binary").fields])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 2048):
            sets = shingle_sets(batch.column(1), width)
            full = [i for i, x in enumerate(sets) if len(x)]
            sketches = np.zeros((len(sets), SKETCH), np.uint64)
            for i in full:
                sketches[i] = similarity_sketch(sets[i])
            high, low = set_hash(sets)
            filled = np.array([len(x) > 0 for x in sets], bool)
            offsets = np.concatenate([[0], np.cumsum(filled * (SKETCH // ROWS))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(sketches[filled]).view(np.int64).ravel() if filled.any() else np.zeros(0, np.int64)))
            small = [x.tobytes() if f else None for x, f in zip(sketches.astype(np.uint16), filled, strict=True)]
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(high), pa.array(low), keys, pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(schema, columns, strict=True)]))

    return sketch, schema


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) -> (node, component): the least node reachable. Least labels of neighbours, then the label's label, until nothing changes."""
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        after = scratch.keep(lower.join(own, "label").select("node", "was", F.least("label", "further").alias("component")), "labels")
        settled = after.filter("component <> was").isEmpty()
        scratch.drop(labels)
        labels = after
        if settled:
            return labels.select("node", "component")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. The texts of a stream past that of b, in blocks of about BLOCK of them."""
    schema = T.StructType([f for f in pairs.schema if f.name in "ab"])
    totals = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.hash("a"), F.col("blocks")).alias("block")
    streamed = pairs.select("a", "b").join(totals, "b").select("a", "b", block).join(texts.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("group"), "block", F.lit(True).alias("probe"), F.col("a").alias("node"), "text")
    hubs = totals.join(texts.withColumnRenamed("node", "b"), "b").select(F.col("b").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("probe"), F.col("b").alias("node"), "text")
    dealt = hubs.unionByName(streamed).repartition("group", "block").sortWithinPartitions("group", "block", "probe")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in split_batches(batches, 2048):
            keep = []
            for x, probe in zip(shingle_sets(batch.column("text"), width), batch.column("probe").to_pylist(), strict=True):
                if not probe:  # stands before its block's rows
                    hub = x
                common = len(np.intersect1d(x, hub, assume_unique=True)) if probe else 0
                keep.append(100 * common >= percent * (len(x) + len(hub) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("group")], schema=arrow_schema(schema)).filter(pa.array(keep))

    return scratch.keep(dealt.mapInArrow(test, schema), "links")


def _walk(batches: Iterator[pa.RecordBatch], prepare, compare) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, block and probe. Of each group and block, a block's own rows are held and prepared; its probes stream past them."""
    last, held, ready = None, [], None
    for batch in split_batches(batches, 4096):
        group, block, probe = batch.column("group").to_pylist(), batch.column("block").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
        changes = [i for i in range(1, len(group)) if group[i] != group[i - 1] or block[i] != block[i - 1] or probe[i] != probe[i - 1]]
        for a, b in zip([0, *changes], [*changes, len(group)], strict=True):
            if (group[a], block[a]) != last:
                last, held, ready = (group[a], block[a]), [], None
            if not probe[a]:
                held.append(batch.slice(a, b - a))
            elif held:
                ready = ready or prepare(pa.Table.from_batches(held).combine_chunks())
                yield from compare(ready, batch.slice(a, b - a))


def _sketches(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint16).reshape(len(rows), -1)


def _near_components(dealt: DataFrame, percent: int) -> DataFrame:
    """dealt: group, block, probe, node, n, component, sketch -> (node, component): probes and other components of which a member's sketch is close."""
    schema = T.StructType([T.StructField(x, dealt.schema["node"].dataType) for x in ("node", "component")])

    def prepare(rows: pa.Table):
        component = rows["component"].combine_chunks()
        return _sketches(rows["sketch"]), rows["n"].to_numpy(), component, np.array(component.to_pylist(), object)

    def compare(ready, probes: pa.RecordBatch):
        sketches, size, component, known = ready
        own, n, part = _sketches(probes.column("sketch")), probes.column("n").to_numpy(), np.array(probes.column("component").to_pylist(), object)
        for i in range(len(own)):
            at = np.flatnonzero((known != part[i]) & (100 * np.minimum(size, n[i]) >= percent * np.maximum(size, n[i])))
            at = at[(sketches[at] == own[i]).mean(axis=1) >= MAYBE] if len(at) else at
            if len(at):
                found = component.take(pa.array(at)).unique()
                yield pa.RecordBatch.from_arrays([probes.column("node").take(pa.array(np.full(len(found), i))), found], schema=arrow_schema(schema))

    return dealt.mapInArrow(lambda batches: _walk(batches, prepare, compare), schema)


def _exact_links(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """dealt: group, block, probe, node, sketch, text -> (a, b): each probe with one row of the block whose full set is similar enough."""
    schema = T.StructType([T.StructField(x, dealt.schema["node"].dataType) for x in ("a", "b")])

    def prepare(rows: pa.Table):
        sets = shingle_sets(rows["text"].combine_chunks(), width)
        return _sketches(rows["sketch"]), sets, rows["node"].combine_chunks()

    def compare(ready, probes: pa.RecordBatch):
        sketches, sets, nodes = ready
        own, mine = _sketches(probes.column("sketch")), shingle_sets(probes.column("text"), width)
        one, two = [], []
        for i, x in enumerate(mine):
            agree = (sketches == own[i]).mean(axis=1)
            for j in np.argsort(-agree, kind="stable"):
                if agree[j] < MAYBE:
                    break
                common = len(np.intersect1d(x, sets[j], assume_unique=True))
                if 100 * common >= percent * (len(x) + len(sets[j]) - common) > 0:
                    one.append(i)
                    two.append(j)
                    break
        if one:
            yield pa.RecordBatch.from_arrays([probes.column("node").take(pa.array(one)), nodes.take(pa.array(two))], schema=arrow_schema(schema))

    return dealt.mapInArrow(lambda batches: _walk(batches, prepare, compare), schema)


def _in_blocks(own: DataFrame, probes: DataFrame, total) -> DataFrame:
    """Rows of a group in blocks of about BLOCK, and each of its probes at every block. Both have group, and `total` (of the group's own rows)."""
    blocks = F.ceil(total / BLOCK).cast("int")
    build = own.withColumn("block", F.pmod(F.hash("node"), blocks)).withColumn("probe", F.lit(False)).drop("total")
    streamed = probes.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("probe", F.lit(True)).drop("total")
    return build.unionByName(streamed).repartition("group", "block").sortWithinPartitions("group", "block", "probe")


def near_duplicates(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row a row of the frame."""
    spark = frame.sparkSession
    scratch = Scratch(spark, "near")
    source = frame.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    sketch, schema = _sketched(source.schema[0].dataType, width)
    docs = scratch.keep(source.mapInArrow(sketch, schema), "docs")
    able = docs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = not able.groupBy("doc_id").count().filter("count > 1").isEmpty()
    own = F.concat_ws(":", F.col("doc_id").cast("string"), "high", "low") if repeated else F.col("doc_id")
    able = able.withColumn("own", own)
    classes = scratch.keep(able.groupBy("high", "low").agg(F.min("own").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    nodes = able.join(classes.select("high", "low", F.col("node").alias("own")), ["high", "low", "own"], "left_semi").select(F.col("own").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch")
    nodes = scratch.keep(nodes.dropDuplicates(["node"]) if repeated else nodes, "nodes")
    in_bands = nodes.select(F.explode("bands").alias("key"), "node", "n")
    shared = in_bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("least"), F.max("node").alias("most")).filter("least.node < most").select("key", "least")
    members = scratch.keep(in_bands.join(shared, "key"), "members")
    texts = scratch.keep(_texts_of(members.select("node").distinct(), source, width, repeated), "texts")
    same = _same_identifier(able, classes) if repeated else None

    def labelled(links: DataFrame) -> DataFrame:
        return components(links.unionByName(same) if repeated else links, scratch)

    # 2. one pair a node: its buckets' smallest node of a size that can link
    able_sizes = 100 * F.least("n", F.col("least.n")) >= percent * F.greatest("n", F.col("least.n"))
    pairs = scratch.keep(members.filter((F.col("node") > F.col("least.node")) & able_sizes).groupBy(F.col("node").alias("a")).agg(F.min("least.node").alias("b")), "pairs")
    links = _verify(pairs, texts, width, percent, scratch)
    tested = pairs.select("a", "b")
    labels = labelled(links)
    # 3. in buckets of several components: nodes outside the largest against one node of it
    for seed in (1, 2):
        apart, largest = _apart(members, labels, seed)
        apart = scratch.keep(apart, "apart")
        if apart.isEmpty():
            break
        if seed == 1:
            candidates = apart.join(largest, "key").filter((F.col("component") != F.col("top.component")) & (100 * F.least("n", F.col("top.chosen.n")) >= percent * F.greatest("n", F.col("top.chosen.n"))))
            pairs = candidates.groupBy(F.col("node").alias("a"), F.col("top.component").alias("c")).agg(F.min("top.chosen.node").alias("b")).select("a", "b")
            pairs = scratch.keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            more = _verify(pairs, texts, width, percent, scratch)
        else:  # 4. all that is left: which components are near a node, then the node against their members
            sized = apart.join(nodes.select("node", "sketch"), "node").join(largest, "key").withColumnRenamed("key", "group")
            columns = ["group", "node", "n", "component", "sketch", "total"]
            dealt = _in_blocks(sized.select(*columns), sized.filter(F.col("component") != F.col("top.component")).select(*columns), F.col("total"))
            near = scratch.keep(_near_components(dealt, percent).distinct(), "near")
            within = members.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("group"))
            within = scratch.keep(within.join(near.select(F.col("component").alias("group")).distinct(), "group", "left_semi"), "within")
            totals = within.groupBy("group").agg(F.count("*").alias("total"))
            full = texts.join(nodes.select("node", "sketch"), "node")
            probes = near.select("node", F.col("component").alias("group"))
            dealt = _in_blocks(within.join(totals, "group").join(full, "node"), probes.join(totals, "group").join(full, "node"), F.col("total"))
            more = scratch.keep(_exact_links(dealt, width, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = labelled(links)
    linked = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if repeated:  # a label is a node there; the component is the least identifier in it
        linked = linked.join(linked.groupBy("component").agg(F.min("least").alias("id")), "component").filter("copies > 1 OR id <> least").select("high", "low", F.col("id").alias("component"))
    else:
        linked = linked.filter("copies > 1 OR component <> node").select("high", "low", "component")
    linked = scratch.keep(linked, "linked")
    scratch.drop_others(docs, linked)
    result = docs.select("doc_id", "n_shingles", "high", "low").join(linked, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    if repeated:  # blank rows have no node, but share their identifier's component
        least = out.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        out = out.drop("component_id").join(least, "doc_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _texts_of(wanted: DataFrame, source: DataFrame, width: int, repeated: bool) -> DataFrame:
    """node, text of the wanted nodes. Where identifiers repeat, a row's node is known by its set, which is made again for the rows in question."""
    if not repeated:
        return source.join(wanted.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    some = source.withColumn("doc_id", F.col("doc_id").cast("string")).join(wanted.select(F.regexp_replace("node", ":-?[0-9]+:-?[0-9]+$", "").alias("doc_id")).distinct(), "doc_id", "left_semi")
    schema = ddl("node string, text string")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches, 2048):
            high, low = set_hash(shingle_sets(batch.column(1), width))
            names = [f"{x}:{h}:{w}" for x, h, w in zip(batch.column(0).to_pylist(), high.tolist(), low.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], schema=arrow_schema(schema))

    return some.select("doc_id", "text").mapInArrow(name, schema).join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def _same_identifier(able: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the nodes of one identifier: each to the least of them."""
    held = able.select("doc_id", "high", "low").distinct().join(classes.select("high", "low", "node"), ["high", "low"]).select("doc_id", "node")
    least = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held.join(least, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b").distinct()


def _apart(members: DataFrame, labels: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that have several components; and each such bucket's members and largest component with one node of it."""
    marked = members.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = marked.groupBy("key", "component").agg(F.count("*").alias("count"), F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(seed))).alias("chosen"))
    largest = parts.groupBy("key").agg(F.max(F.struct("count", "component", "chosen")).alias("top"), F.sum("count").alias("total"), F.count("*").alias("parts")).filter("parts > 1").select("key", "top", "total")
    return marked.join(largest.select("key"), "key", "left_semi"), largest


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
l AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS list, len(words) AS n_words FROM w),
s AS (SELECT doc_id, unnest(list) AS shingle FROM l),
n AS (SELECT doc_id, CAST(len(list) AS BIGINT) AS n FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON r.node = u.a WHERE u.b > r.root),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, coalesce(c.root, n.doc_id) AS component_id, coalesce(c.root, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON n.doc_id = c.node
"""
