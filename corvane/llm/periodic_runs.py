"""Periodic runs of words in whole texts, by the linear tandem-repeat method of Gusfield and Stoye.

Texts of a batch are one string of numbered words with separators that occur once. Over it stand the names of all blocks of 1, 2, 4, ...
words (equal blocks have equal names, in dictionary order), which give the suffix array and the common extension of two places. The suffix
tree is kept as this array: a node is a range of it, a suffix link leads from the range of `ax` to that of `x`.

1. LZ blocks: the longest earlier match of each place, from its neighbours in the array. Common extensions around the blocks' borders give
   squares (`xx`) that cover the leftmost place of every square.
2. Walks over suffix links: from each such square to its rotation by a word, as long as the string has it. What the same place goes on
   with is one step, whatever its length; a walk ends after a full turn or where another one has been. That is the whole vocabulary of
   squares with a root that isn't itself repeated.
3. The ranges of these squares list all their places; consecutive places of one root length are a run, which no neighbour extends.

Before that, words go that cannot lie in a run of the wanted exponent e: in such a run every word occurs e times, every pair of neighbours
e - 1 times, every four words e - 2 times. What is left of ordinary prose is little; nothing that a run contains is lost.

Memory is bounded by a batch of texts, or by one text if that is larger (about 4 bytes a left word and level of names). No shuffle.

Defined cases: a null or empty text, or one of white space alone, has no words and no runs; a null identifier is kept as it is; repeated
rows are texts of their own; an empty table gives no rows; extra columns don't take part, whatever their names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import arrow_schema, split_batches, table, whole_texts

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUN = "struct<start:long,length:long,period:long>"


class SuffixNames:
    """Names of all power-of-two blocks of a string, its suffix array, and what two places have in common."""

    def __init__(self, symbols: np.ndarray):
        """symbols: numbers from 0; the string is extended by a sign before all others."""
        n = self.n = len(symbols)
        self.symbols = np.append(symbols, -1)
        levels, width = [np.append(np.unique(symbols, return_inverse=True)[1], -1).astype(np.int32)], 1
        while n and levels[-1].max() < n - 1:
            here = levels[-1][:-1].astype(np.int64)
            beside = np.full(n, -1, np.int64)
            beside[: n - width] = here[width:] if width < n else beside[: n - width]
            levels.append(np.append(np.unique(here * (n + 1) + beside + 1, return_inverse=True)[1], -1).astype(np.int32))
            width *= 2
        self.names, self.top = np.stack(levels), len(levels) - 1
        self.rank = self.names[-1][:-1].astype(np.int64)
        self.array = np.empty(n, np.int64)
        self.array[self.rank] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many signs from i on are those from j on; i and j differ."""
        i, j, n = i.copy(), j.copy(), self.n
        begin = i.copy()
        for level in range(self.top, -1, -1):
            names = self.names[level]
            step = (names[np.minimum(i, n)] == names[np.minimum(j, n)]).astype(np.int64) << level
            i += step
            j += step
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many signs up to i, itself included, are those up to j."""
        i, j = i + 1, j + 1
        end = i.copy()
        for level in range(self.top, -1, -1):
            names, width = self.names[level], 1 << level
            fits = (i >= width) & (j >= width)
            fits &= names[np.where(fits, i - width, 0)] == names[np.where(fits, j - width, self.n)]
            step = fits.astype(np.int64) << level
            i -= step
            j -= step
        return end - i

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether so many signs (one at least) from i on are those from j on: by two blocks that cover them."""
        level = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, self.top)
        last, n = length - (np.int64(1) << level.astype(np.int64)), self.n
        return (self.names[level, i] == self.names[level, j]) & (self.names[level, np.minimum(i + last, n)] == self.names[level, np.minimum(j + last, n)])

    def first_rank(self, low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
        """The least rank from low to high, high excluded, from which on `holds` is true; high if it never is."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            true = holds(self.array[np.minimum(middle, self.n - 1)])
            high = np.where(open_ & true, middle, high)
            low = np.where(open_ & ~true, middle + 1, low)
        return low

    def node(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with so many signs from i on."""
        at = self.rank[i]
        low = self.first_rank(np.zeros_like(at), at, lambda s: self.equal(s, i, length))
        high = self.first_rank(at + 1, np.full_like(at, self.n), lambda s: ~self.equal(s, i, length))
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of a node's range whose suffixes go on with the sign."""
        after = lambda s: self.symbols[np.minimum(s + length, self.n)]
        first = self.first_rank(low, high, lambda s: after(s) >= symbol)
        return first, self.first_rank(first, high, lambda s: after(s) > symbol)

    def longest_earlier(self) -> np.ndarray:
        """For each place, how much of what follows also begins at an earlier place: at one of its two neighbours among the earlier suffixes."""
        n, rank = self.n, self.rank.tolist()
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        left, right = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):  # the later suffixes are taken out first
            r = rank[i]
            b, a = left[i], right[i] = before[r], after[r]
            if b >= 0:
                after[b] = a
            if a < n:
                before[a] = b
        longest, places = np.zeros(n, np.int64), np.arange(n)
        for side in (np.array(left), np.array(right)):
            has = (side >= 0) & (side < n)
            longest[has] = np.maximum(longest[has], self.forward(places[has], self.array[side[has]]))
        return longest


def _counted(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): rows repeated, with the numbers from `starts` on."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[rows]


def covering_squares(text: SuffixNames) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares from which rotations reach the leftmost place of every square.

    The right half of a leftmost square begins in some block and ends in it or in the next one, and the square is not all inside the block:
    so either the right half crosses the block's end, or the left half its begin.
    """
    n, reach = text.n, np.maximum(text.longest_earlier(), 1).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += reach[at]
    begin, size = np.array(starts, np.int64), np.diff(np.array([*starts, n], np.int64))
    found = []
    # across the end h1 of a block
    h, h1 = begin[:-1], begin[1:]
    rows, k = _counted(np.ones_like(h), np.minimum(size[:-1] + size[1:], h1))
    h, h1 = h[rows], h1[rows]
    ahead = text.forward(h1 - k, h1)
    behind = text.backward(h1 - k - 1, h1 - 1)
    start = np.maximum(h1 - k - behind, np.maximum(h - k, 0))
    good = start <= np.minimum(h1 - k - 1, h1 + ahead - 2 * k)
    found.append((start[good], k[good]))
    # across the begin h of a block
    rows, k = _counted(np.ones_like(begin), np.minimum(size, n - begin))
    h = begin[rows]
    ahead = text.forward(h, h + k)
    behind = text.backward(h - 1, h + k - 1)
    start = np.maximum(h - behind, np.maximum(h - k, 0))
    good = start <= np.minimum(h - 1, h + ahead - k)
    found.append((start[good], k[good]))
    both = np.unique(np.concatenate([k * n + i for i, k in found]))
    return both % n, both // n


def primitive(text: SuffixNames, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the root of the square at i isn't itself a repetition: tried for each prime that divides its length."""
    rest, good = k.copy(), np.ones(len(k), bool)
    least = np.arange(int(k.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            least[p * p :: p] = np.minimum(least[p * p :: p], p)
    while (open_ := np.flatnonzero(rest > 1)).size:
        p = least[rest[open_]]
        d = k[open_] // p
        good[open_] &= ~text.equal(i[open_], i[open_] + d, 2 * k[open_] - d)
        rest[open_] //= p
    return good


def vocabulary_of_squares(text: SuffixNames, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct squares with primitive roots, each at some place, by walks from the covering ones."""
    been, places, roots = set(), [], []
    turned = np.zeros_like(i)
    while len(i):
        more = np.minimum(text.forward(i, i + k) - k, k - 1 - turned)  # the same place goes on for so many rotations
        rows, offset = _counted(np.zeros_like(i), more + 1)
        places.append(i[rows] + offset)
        roots.append(k[rows])
        turned += more + 1
        go = turned < k
        i, k, turned = i[go] + more[go], k[go], turned[go]
        if not len(i):
            break
        low, high = text.node(i + 1, 2 * k - 1)  # the suffix link of all but the square's last sign
        low, high = text.child(low, high, 2 * k - 1, text.symbols[i])
        new = low < high
        for at, key in enumerate(zip(low.tolist(), k.tolist(), strict=True)):
            if new[at]:
                new[at] = key not in been
                been.add(key)
        i, k, turned = text.array[np.minimum(low[new], text.n - 1)], k[new], turned[new]
    return np.concatenate(places), np.concatenate(roots)


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal repetitions of a string, by period, then start."""
    none = np.zeros(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    text = SuffixNames(symbols)
    i, k = covering_squares(text)
    good = primitive(text, i, k)
    i, k = i[good], k[good]
    if not len(i):
        return none, none, none
    i, k = vocabulary_of_squares(text, i, k)
    key = np.unique(k * text.n + i)
    i, k = key % text.n, key // text.n
    low, high = text.node(i, 2 * k)
    _, first = np.unique(k * text.n + low, return_index=True)
    low, high, k = low[first], high[first], k[first]
    rows, ranks = _counted(low, high - low)
    key = np.sort(k[rows] * text.n + text.array[ranks])  # every place of every square, by root length and place
    place, root = key % text.n, key // text.n
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(root) != 0)]))
    closes = np.append(opens[1:], len(key)) - 1
    return place[opens], place[closes] - place[opens] + 2 * root[opens], root[opens]


def _frequent(keys: np.ndarray, least: int) -> np.ndarray:
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return (counts >= least)[which]


def may_repeat(words: np.ndarray, text: np.ndarray, least_length: int, exponent: int) -> np.ndarray:
    """Which words can lie in a run of at least that exponent; all others occur too rarely, alone or with their neighbours, in their text."""
    kept, shortest = _frequent(text * (int(words.max(initial=0)) + 1) + words, exponent), max(least_length, exponent)
    names = np.unique(words, return_inverse=True)[1].astype(np.int64)
    for width, least in ((2, exponent - 1), (4, min(exponent - 2, shortest - 3))):
        n = len(words) - width + 1
        if least < 2 or shortest < width or n < 1:
            continue
        half = width // 2
        ends = np.cumsum(~kept)
        whole = kept[:n] & (ends[width - 1 :] == ends[:n]) & (text[:n] == text[width - 1 :])
        at = np.flatnonzero(whole)
        pair = names[at] * (int(names.max(initial=0)) + 1) + names[at + half]
        values, number = np.unique(pair, return_inverse=True)
        often = at[_frequent(text[at] * (len(values) + 1) + number, least)]
        names = np.full(len(words), len(values), np.int64)
        names[at] = number
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, often, 1)
        np.add.at(cover, often + width, -1)
        kept = np.cumsum(cover)[:-1] > 0
    return kept


def runs_in_texts(words: np.ndarray, sizes: np.ndarray, least_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words: numbers of the words of all texts, one after another -> (text, start in it, length, period), by text, start, period."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    kept = np.flatnonzero(may_repeat(words, text, least_length, exponent)) if len(words) else np.zeros(0, np.int64)
    breaks = np.concatenate([[True], (np.diff(kept) != 1) | (np.diff(text[kept]) != 0)])[: len(kept)]
    stretch = np.cumsum(breaks) - 1
    long = (np.bincount(stretch) >= max(least_length, exponent))[stretch] if len(kept) else np.zeros(0, bool)
    kept, stretch = kept[long], np.unique(stretch[long], return_inverse=True)[1]
    # one separator before each stretch
    string = np.zeros(len(kept) + (int(stretch.max()) + 1 if len(kept) else 0), np.int64)
    where = np.arange(len(kept)) + stretch + 1
    names = np.unique(words[kept], return_inverse=True)[1]
    string[:] = names.max(initial=-1) + 1 + np.cumsum(np.isin(np.arange(len(string)), where, invert=True))
    string[where] = names
    place = np.zeros(len(string), np.int64)
    place[where] = kept
    start, length, period = runs_of(string)
    good = (length >= least_length) & (length >= exponent * period)
    start, length, period = place[start[good]], length[good], period[good]
    owner = text[start]
    start = start - (np.cumsum(sizes) - sizes)[owner]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between two, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])


def _read_runs(batches, schema: T.StructType, least_length: int, exponent: int):
    kind = arrow_schema(schema)
    for batch in split_batches(batches, 4096, 2 << 20):
        lists = [t.split() for t in whole_texts(batch.column(1)).cast(pa.large_binary()).to_pylist()]  # bytes: split at ASCII white space alone
        sizes = np.array([len(x) for x in lists], np.int64)
        coded = pa.array([w for x in lists for w in x], pa.large_binary()).dictionary_encode()
        found = runs_in_texts(coded.indices.to_numpy().astype(np.int64), sizes, least_length, exponent)
        runs: list[list] = [[] for _ in lists]
        for owner, *run in zip(*(x.tolist() for x in found), strict=True):
            runs[owner].append(tuple(run))
        collapsed = pa.array([collapse(x, r) for x, r in zip(lists, runs, strict=True)], pa.large_binary()).cast(pa.large_string())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], kind[2].type), collapsed.cast(kind[3].type)], schema=kind
        )


def find_runs(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Each row's identifier, n_words, runs (start, length and smallest period in words, by start and period) and its collapsed text.

    A run is as long as its words keep the period, at least `least_length` words and `least_exponent` periods (a whole number from 2 on).
    """
    if least_exponent < 2 or int(least_exponent) != least_exponent:
        raise ValueError("least_exponent must be a whole number from 2 on")
    texts = frame.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_column, texts.schema[0].dataType), *T._parse_datatype_string(f"n_words long, runs array<{RUN}>, collapsed string").fields])
    return texts.mapInArrow(partial(_read_runs, schema=schema, least_length=least_length, exponent=int(least_exponent)), schema)


def with_planted_periods(key: Column, text: Column) -> Column:
    """The text, or for keys whose crc32 ends in 0, its words from some place on as repetitions of the first ones there."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda j: F.get(w, (a + j % p).cast("int"))))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    rebuilt = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(""))[0]
    return F.when(h % 10 == 0, rebuilt).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_periods(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    most = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "most.start", "most.length", "most.period", F.floor(1000 * F.col("most.length") / F.col("most.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
