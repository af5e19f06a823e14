import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from corvane.llm.prefix_trie import ORACLE, dense_names, op12_prefix_trie, ordered_turns, prefix_trie
from corvane.llm.shared import Scratch
from tests.llm.compare import duck

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rebuilt):
    """Brute force: all prefixes of all conversations, as tuples."""
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        own = (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not children.get(path)
    return sorted((
        (convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest())
        for path, convs in members.items()
    ), key=str)


def plain_rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple(x[2:] for x in sorted(turns)) for c, turns in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, ())[: heads[c]] + own[c][heads[c] :] for c in own}


def by_sql(sf):
    return sorted((tuple(r) for r in duck(sf).sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE})").fetchall()), key=str)


def test_equals_sql_and_brute_force(spark, sf="/root/testdata/sf0.01"):
    got = op12_prefix_trie(spark, sf)
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_trie(plain_rebuild(rows))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert by_sql(sf) == want


def test_edges(spark, tmp_path):
    rng, rows = random.Random(5), []
    for conv in [*range(0, 60), 101, 102, 103, 1000]:
        for turn in range(rng.choice([1, 2, 5, 12])):
            rows.append((conv, rng.choice([turn, turn, None, 1]), rng.choice(["user", "user", None, "assistant"]), rng.choice(["", None, "é same", "same", "same"])))
    rows += [rows[3]] * 3 + [(None, 1, "user", "lost"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "conv_id long, turn long, role string, text string, name long, depth int, position int")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = op12_prefix_trie(spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(plain_trie(plain_rebuild(rows)), key=str) and {r[3] for r in got if r[1] == 0} == {64}
    assert by_sql(str(tmp_path)) == got
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op12_prefix_trie(spark, f"{tmp_path}/none").count() == 0


def test_long_and_common_conversations(spark):
    scratch = Scratch(spark, "test")
    long = [(1, t, "user", f"t{t % 7}") for t in range(600)] + [(2, t, "user", f"t{t % 7}") for t in range(599)] + [(c, 0, "user", "t0") for c in range(3, 9003)]
    frame = spark.createDataFrame(long, "conv_id long, turn long, role string, text string").repartition(5)
    turns = scratch.keep(ordered_turns(frame, scratch), "turns")
    assert turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("d")).filter("n != d OR last != n - 1").count() == 0
    got = prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("n_turns")), scratch)
    by_conv = defaultdict(list)
    for conv, _, role, text in long:
        by_conv[conv].append((role, text))
    rows = {r.depth: r for r in got.collect()}
    assert len(rows) == 601 and rows[0].n_convs == 9002 and rows[1].n_convs == 9002 and rows[2].n_convs == 2 and rows[600].n_convs == 1
    assert all(r.conv_id == 1 and r.n_leaves == 1 for r in rows.values())
    assert rows[0].saved_tokens == 9001 * 2 + 598 * 2 and rows[599].saved_tokens == 2 and rows[600].saved_tokens == 0
    assert rows[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(3, 9003))).encode()).hexdigest()


def test_names_are_dense(spark):
    frame = spark.range(5000).select((F.col("id") % 1777).alias("a"), (F.col("id") % 3).alias("b"))
    got = {(r.a, r.b): r.name for r in dense_names(frame, ["a", "b"], Scratch(spark, "test")).collect()}
    assert sorted(got.values()) == list(range(len(got)))
