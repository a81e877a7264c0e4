"""Byte-level BPE pre-tokens of a batch of texts, found for all its characters at once."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    """Each code point's class."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The matches of public_tokenizers.PATTERN in each text: all as one binary array, and n + 1 offsets of the texts in it.

    Runs of letters, of numbers and of other characters are words, each with the one space before it; white space
    before a word leaves its last character out; an apostrophe by itself takes s, t, m, d, re, ve or ll from the letters behind it.
    """
    joined = "".join(texts)
    data = joined.encode("utf-8", "replace")
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    n = len(code)
    rows = np.cumsum([0, *map(len, texts)])
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    kind = _classes()[code]
    first = np.zeros(n + 1, bool)  # a text begins
    first[rows] = True
    edge = first.copy()  # a run of one class begins
    edge[1:n] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before_word = np.zeros(n, bool)  # white space with a word right behind it in its text
    before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start = edge[:n].copy()
    start |= before_word
    blank = code == 32
    start[1:] &= ~(before_word[:-1] & blank[:-1])
    mark = np.flatnonzero((code == 39) & start & edge[1:])
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        a = code[mark + 1]
        two = np.where(mark + 2 < n, code[np.minimum(mark + 2, n - 1)], 0) * ~first[mark + 2]
        one_letter = np.isin(a, [ord(c) for c in "stmd"])
        two_letters = ((a == ord("r")) | (a == ord("v"))) & (two == ord("e")) | (a == ord("l")) & (two == ord("l"))
        for at, length in ((mark[one_letter], 2), (mark[two_letters & ~one_letter], 3)):
            start[at + 1] = False
            start[(at + length)[at + length < n]] = True
    at = np.flatnonzero(start)
    if len(data) == n:
        offsets = np.append(at, n)
    else:
        size = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        places = np.cumsum(size) - size
        offsets = np.append(places[at], len(data))
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return words, np.searchsorted(at, rows)


class WordIds:
    """Word -> token ids with a bounded memo; encode() gets the words that the memo lacks.

    At `limit` words the memo starts afresh, so a worker's memory doesn't grow with the corpus.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[tuple[int, ...]]], limit: int = 300_000):
        self.encode, self.limit, self.known = encode, limit, {}

    @staticmethod
    def _packed(ids: tuple[int, ...]) -> bytes:
        return struct.pack(f"={len(ids)}I", *ids)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the number of ids before each word (n + 1 offsets)."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = [w for w in distinct if w not in known]
        known.update(zip(new, map(self._packed, self.encode(new)), strict=True))
        each = [known[w] for w in distinct]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), np.uint32)
        begins = np.append(0, np.cumsum(sizes))
        at = coded.indices.to_numpy()
        n = sizes[at]
        offsets = np.append(0, np.cumsum(n))
        return flat[np.repeat(begins[at] - offsets[:-1], n) + np.arange(offsets[-1])], offsets
