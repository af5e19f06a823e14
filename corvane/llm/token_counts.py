"""Token counts by byte-pair merging with a heap and a linked list.

The count is the number of initial symbols less the merges; identifiers are never made. Symbols are characters; the adjacent pair of the
best rank is popped again and again, leftmost first among equals; characters that the vocabulary lacks count their UTF-8 bytes.
Two neighbours that stand side by side in no piece of the vocabulary can never merge across their border, so texts are cut there:
before spaces, and inside words between such characters. Distinct chunks of a batch are counted once.

Defined cases: a null text is an empty one (no bytes, no tokens); identifiers may be null or repeated, and repeated rows are counted
each; texts of any length are counted whole; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import arrow_schema, split_batches, table, whole_texts, worker_state
from corvane.llm.tokens import vocabulary

#: Fixed values of the model file's format: field numbers, and the kinds of pieces that text can match.
PIECES, NORMALIZER, TEXT, SCORE, KIND, NORMAL, USER_DEFINED, UNUSED = 1, 3, 1, 2, 3, 1, 4, 5
DUMMY_PREFIX, REMOVE_EXTRA_SPACES, CHARACTER_MAP = 3, 4, 2
SPACE = "▁"
#: Chunks that a worker remembers; beyond that it starts anew.
CACHE_ENTRIES = 800_000


def _fields(data: bytes):
    """(field number, value) of a protocol-buffer message, in turn."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        wire = key & 7
        if wire == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(wire) or number()
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class MergeCounter:
    """count(chunk): tokens of a text whose spaces are already written as U+2581."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        self.rank: dict[str, float] = {}
        for piece in (dict(_fields(v)) for f, v in message if f == PIECES):
            kind = piece.get(KIND, NORMAL)
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError("vocabularies with user-defined or unused pieces are not supported")
            if kind == NORMAL:
                self.rank[piece[TEXT].decode()] = -struct.unpack("<f", piece[SCORE])[0]
        rules = dict(_fields(next(v for f, v in message if f == NORMALIZER)))
        if rules.get(CHARACTER_MAP) or rules.get(REMOVE_EXTRA_SPACES, 1) or not rules.get(DUMMY_PREFIX, 1):
            raise ValueError("only vocabularies that leave text as it is are supported")
        self.beside = {a + b for piece in self.rank for a, b in zip(piece, piece[1:], strict=False)}
        if any(x[1] == SPACE != x[0] for x in self.beside):
            raise ValueError("a piece has a space after another character")
        self.known: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def merges(self, text: str) -> int:
        """How many times a pair merges."""
        rank, n = self.rank.get, len(text)
        symbols, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapify(heap)
        done = 0
        while heap:
            _, left, pair = heappop(heap)
            right = after[left]
            if symbols[left] is None or right >= n or len(symbols[left]) + len(symbols[right]) != len(pair):
                continue  # one side has merged meanwhile
            symbols[left], symbols[right] = pair, None
            done += 1
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                if (r := rank(pair + symbols[far])) is not None:
                    heappush(heap, (r, left, pair + symbols[far]))
            near = before[left]
            if near >= 0 and (r := rank(symbols[near] + pair)) is not None:
                heappush(heap, (r, near, symbols[near] + pair))
        return done

    def _run(self, text: str) -> int:
        if (n := self.known.get(text)) is None:
            alone = sum(1 if c in self.rank else len(c.encode()) for c in text)
            n = alone - (self.merges(text) if len(text) > 1 else 0)
            if len(text) <= 64:
                self.known[text] = n
        return n

    def count(self, chunk: str) -> int:
        total = start = 0
        beside = self.beside
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in beside:
                total += self._run(chunk[start:i])
                start = i
        return total + (self._run(chunk[start:]) if chunk else 0)

    def text(self, text: str) -> int:
        """Any text, runs of spaces included."""
        return sum(map(self.count, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", SPACE + text.replace(" ", SPACE)))) if text else 0

    def batch(self, texts: pa.Array) -> np.ndarray:
        texts = whole_texts(texts)
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        if odd.any():
            out[odd] = [self.text(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        if odd.all():
            return out
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        coded = lists.flatten().dictionary_encode()
        chunks, counts = self.chunks, []
        for key in coded.dictionary.to_pylist():
            if (n := chunks.get(key)) is None:
                n = self.count(SPACE + key)
                if len(key) <= 48:
                    chunks[key] = n
            counts.append(n)
        if len(chunks) + len(self.known) > CACHE_ENTRIES:
            chunks.clear()
            self.known.clear()
        ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[coded.indices.to_numpy()])])
        out[~odd] = np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])
        return out


def count_tokens(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Each row's identifier, bytes, tokens, and whether these are over the limit. No shuffle; one pass over the texts."""
    path = vocabulary(model)
    texts = frame.select(id_column, F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_column, texts.schema[0].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def counted(batches):
        counter, kind = worker_state(("merges", path), lambda: MergeCounter(path)), arrow_schema(schema)
        for batch in split_batches(batches, 16384, 16 << 20):
            tokens = counter.batch(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)], schema=kind)

    return texts.mapInArrow(counted, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
