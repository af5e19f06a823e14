"""Continuous forms: taint over an event stream with state by user, and a scan that follows a folder of events."""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

OUT = "event_id long, user_id long, source_event_id long"
STATE = "history string"
#: How far behind the newest event of its user an event may come and still be placed among those before it.
LATENESS_SECONDS = 3600


def follow(key: tuple, frames: Iterator[pd.DataFrame], state, lateness: int = LATENESS_SECONDS) -> Iterator[pd.DataFrame]:
    """A sink after a source that nothing ended in between is a row, in the order of (time, number) that batches have.

    All frames of the group are one sorted list with what the state holds: the sources and endings of the last `lateness` seconds, and the
    last of each before. So an event that comes late still meets what stands before it; rows already given stay as they were.
    """
    held = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []  # (microseconds, event, kind: 0 ends, 1 begins)
    fresh = []
    for frame in frames:
        at = frame["ts"].astype("datetime64[us]").astype("int64")
        fresh += list(zip(at.tolist(), frame["event_id"].tolist(), frame["event_type"].tolist(), strict=True))
    for at, event, kind in fresh:
        if kind in ("signup", "error", "view"):
            insort(held, (at, event, int(kind == "signup")))
    sinks = sorted((at, event) for at, event, kind in fresh if kind == "purchase")
    rows, place, source, stopped = [], 0, None, None
    for at, event in sinks:
        while place < len(held) and held[place][:2] < (at, event):
            if held[place][2]:
                source = held[place][:2]
            else:
                stopped = held[place][:2]
            place += 1
        if source is not None and (stopped is None or source > stopped):
            rows.append((event, int(key[0]), source[1]))
    newest = max([x[0] for x in held] + [x[0] for x in fresh], default=0)
    recent = [x for x in held if x[0] >= newest - lateness * 1_000_000]
    older = [x for x in held if x[0] < newest - lateness * 1_000_000]
    last = [next((x for x in reversed(older) if x[2] == kind), None) for kind in (0, 1)]
    state.update((json.dumps(sorted([*[x for x in last if x], *recent])),))
    yield pd.DataFrame(rows, columns=["event_id", "user_id", "source_event_id"])


def tainted_stream(events: DataFrame, lateness: int = LATENESS_SECONDS) -> DataFrame:
    """events: a stream (event_id, ts, user_id, event_type). State: a user's sources and endings of the last `lateness` seconds, and one of each before."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("user_id").applyInPandasWithState(lambda key, frames, state: follow(key, frames, state, lateness), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, folder: str, schema, checkpoint: str, target: str) -> None:
    """Takes what is new in a folder of event files through the stream, and stops when all is taken. Only unseen files are read."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = tainted_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
