"""Exact identifiers of the `tokenizers` library at the speed of array lookups.

Where no white space stands beside other white space, every tokenizer of the family starts a new piece before a space and at a line
end, so a chunk between two such places has identifiers that don't depend on its neighbours. A batch is cut into chunks, its distinct
chunks are found in Arrow, and only those not yet known reach the library. Other texts go to the library whole. So the identifiers are
the library's own in every case.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.shared import whole_texts, worker_state

#: Chunks that a worker remembers (about 200 bytes each); beyond that it starts anew.
CACHE_ENTRIES = 400_000
#: Longer chunks are forgotten after their batch, so that the memory of the cache is bounded whatever the texts hold.
CHUNK_CHARS = 48
#: A chunk that the model may encode without the library's pattern: letters alone.
LETTERS_ALONE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Every pattern of the family cuts between a letter and these signs (apostrophes are left out: they may begin a suffix).
SIGNS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!#$%&*,.:;?|])"
#: Before a chunk that no space stands before.
CLOSE = "\x02"
#: Texts that go to the library whole: with white space beside white space where that has identifiers, a special string, or a character that isn't surely no white space.
RUNS = r"[ \n][ \n]"
OTHERS = r"<\||[^\n\x20-\x7e\x{a1}-\x{167f}\x{1681}-\x{180d}\x{180f}-\x{1fff}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{2070}-\x{2fff}\x{3001}-\x{d7ff}\x{f900}-\x{fdff}\x{1f000}-\x{1faff}]"
#: How byte-level vocabularies write the bytes of a letter: printable Latin-1 characters stand for themselves, the rest follow from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in set(_SHOWN)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_REST)}
LETTERS = {c: "".join(BYTE_CHARS[b] for b in chr(c).encode()) for c in range(0x20, 0x100)}


class PackedEncoder:
    """batch(texts) -> all identifiers of the texts in turn, and how many each text has.

    Keys of the cache: a chunk without the space before it; where none stands before it, a mark; or a line end alone.
    Where white space has no identifiers, the vocabulary is one of lower-case words, and keys are lower-case chunks alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = bool(self._ids(" "))  # does white space have identifiers?
        self.line = self._ids("\n")
        probe = ["Émile", "queß", "thandering", "Zo", "a"]  # do words alone give what the whole gives?
        self.by_model = all(self._part(x) == self._ids(x) and self._part(" " + x) == self._ids(" " + x) for x in probe)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _part(self, word: str) -> list[int]:
        """Of letters, with the space before them if white space counts."""
        word = word if self.spaced else word.lower().lstrip()
        return [t.id for t in self.model.tokenize(word.translate(LETTERS))] if word else []

    def _of(self, key: str) -> list[int]:
        space, text = (" ", key) if self.spaced else ("", key)
        if key[:1] == CLOSE:
            space, text = "", key[1:]
        if key == "\n":
            return self.line
        return self._part(space + text) if self.by_model and LETTERS_ALONE.fullmatch(text) else self._ids(space + text)

    def _learn(self, fresh: list[str]) -> None:
        known, n = self.known, len(self.known)
        new = [self._of(key) for key in fresh]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        total = int(sizes.sum())
        while n + len(new) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in new for i in ids), np.uint32, total)
        self.starts[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[n : n + len(new)] = sizes
        self.used += total
        known.update(zip(fresh, range(n, n + len(new)), strict=True))

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            text = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(CLOSE, pa.large_string()), texts, pa.scalar("", pa.large_string())), "\n", f" \n {CLOSE}")
            texts = pc.replace_substring_regex(text, SIGNS, f"\\1 {CLOSE}\\2")
        else:  # A-Z alone: what the library's own lower-casing does to the rest is left to it
            texts = pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), SIGNS, "\\1 \\2")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        keys = coded.dictionary.to_pylist()
        get = self.known.get
        slots = [get(k, -1) for k in keys]
        fresh = [k for k, at in zip(keys, slots, strict=True) if at < 0]
        long = [k for k in fresh if len(k) > CHUNK_CHARS]
        if fresh:
            self._learn([k for k in fresh if len(k) <= CHUNK_CHARS] if long else fresh)
            used = self.used
            if long:
                self._learn(long)
            slots = [self.known[k] for k in keys]
        slots = np.array(slots, np.int64)[coded.indices.to_numpy()]
        sizes = self.lengths[slots]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for k in long:
            del self.known[k]
        if long:
            self.used = used
        if len(self.known) > CACHE_ENTRIES or len(self.flat) > 8 * CACHE_ENTRIES:
            self._forget()
        return ids, np.diff(bounds)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = whole_texts(texts)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.match_substring_regex(texts, f"{RUNS}|{OTHERS}" if self.spaced else OTHERS).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._chunked(texts)
        ids, sizes = self._chunked(texts.filter(pa.array(~whole))) if not whole.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        cut = np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []
        rest, chunked = iter([np.array(self._ids(x), np.uint32) for x in texts.filter(pa.array(whole)).to_pylist()]), iter(cut)
        all_ids = [next(rest if w else chunked) for w in whole]
        return np.concatenate(all_ids), np.array([len(x) for x in all_ids], np.int64)


def encoder(path: str) -> PackedEncoder:
    return worker_state(("encoder", path), lambda: PackedEncoder(path))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; an absolute path stays."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
