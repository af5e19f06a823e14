"""Levels by contraction, held against rounds one by one."""

import random

import pytest

from corvane.llm import chats
from corvane.llm.chats import dependency_levels
from corvane.llm.shared import Scratch

SCHEMA = "conv_id long, call_id string, depends_on array<string>"


def by_rounds(rows):
    needs = {}
    for conv, call, own in rows:
        needs.setdefault((conv, call), set()).update(own or [])
    levels, n = dict.fromkeys(needs), 0
    while True:
        ready = [k for k, own in needs.items() if levels[k] is None and all(levels.get((k[0], x)) is not None for x in own)]
        if not ready:
            return levels
        levels |= dict.fromkeys(ready, n)
        n += 1


def held(spark, rows):
    got = dependency_levels(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({(r.conv_id, r.call_id) for r in got})
    assert {(r.conv_id, r.call_id): r.level for r in got} == by_rounds(rows)


@pytest.mark.parametrize("seed", range(4))
def test_equals_rounds(spark, seed):
    """Graphs with branches, meetings, circles, unknown and null needs, repeated calls with needs of their own."""
    pick, rows = random.Random(seed), []
    for conv in range(30):
        n, back = pick.randrange(1, 25), pick.random() < 0.3
        for i in range(n):
            among = range(n + (pick.random() < 0.1)) if back else range(max(0, i - pick.choice([1, 3, 25])), i)
            own = [str(x) for x in pick.sample(list(among), min(len(among), pick.choice([0, 1, 1, 1, 2, 3])))]
            rows += [(conv, str(i), pick.choice([own, own + own, own + [None]] if pick.random() < 0.05 else [own]))] * pick.choice([1, 1, 2])
        if pick.random() < 0.3:
            rows.append((conv, "0", None))
    held(spark, rows)


def test_shapes(spark):
    """Chains whose calls need the first one too, ladders, trees, a hot need, circles with tails, and circles behind chains."""
    rows = [(1, str(i), [str(i - 1), "0"] if i > 1 else ["0"] if i else []) for i in range(40)]
    rows += [(2, f"{s}{i}", [f"a{i - 1}", f"b{i - 1}"] if i else []) for i in range(6) for s in "ab"]
    rows += [(3, str(i), [str(2 * i + 1), str(2 * i + 2)] if i < 31 else []) for i in range(63)]
    rows += [(4, str(i), ["hot"]) for i in range(500)] + [(4, "hot", [])]
    rows += [(5, str(i), [str((i + 1) % 7)]) for i in range(7)] + [(5, f"t{i}", [f"t{i - 1}" if i else "0"]) for i in range(9)] + [(5, "m", ["t8", "free"]), (5, "free", [])]
    held(spark, rows)


def test_a_long_chain_in_few_tables(spark, monkeypatch):
    """A thousand calls one after another, beside a circle: tables go with the logarithm."""
    written, keep = [], Scratch.keep
    monkeypatch.setattr(chats.Scratch, "keep", lambda self, frame, name, **o: written.append(name) or keep(self, frame, name, **o))
    rows = [(1, str(i), [str(i - 1)] if i else []) for i in range(1000)] + [(2, "a", ["b"]), (2, "b", ["a"])]
    got = {(r.conv_id, r.call_id): r.level for r in dependency_levels(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, str(i)): i for i in range(1000)} | {(2, "a"): None, (2, "b"): None} and len(written) < 12


def test_no_calls(spark):
    assert dependency_levels(spark.createDataFrame([], SCHEMA)).collect() == []
