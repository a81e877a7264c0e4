"""Word and shingle hashes of a batch of texts, for all its bytes at once."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Multipliers of a gram's words, by place.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        inverse = pow(int(_ODD), -1, 1 << 64)
        for i, base in enumerate((_ODD, np.uint64(inverse))):
            _POWERS[i] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16) - 1, base)), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space (space, 09-0D), A-Z lower-cased: their 64-bit hashes, n + 1 offsets of the texts in
    them, and where each word begins and ends among the bytes of its text."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        parts = [p.lower() for p in parts]
    joined = b" ".join([*parts, b""])
    data = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~_IS_SPACE[data]
    start, end = np.ascontiguousarray(np.flatnonzero(word[1:] != word[:-1]).reshape(-1, 2).T)  # they take turns
    rows = np.searchsorted(start, begins)
    out = np.empty(len(start), np.uint64)
    step = 1 << 18  # bytes at a time; a longer word is done by itself
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        a, b = int(start[i]), int(end[j - 1])
        power, inverse = _powers(b - a)
        sums = np.append(np.uint64(0), np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64))
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mixed((sums[e] - sums[s]) * inverse[s])
        i = j
    base = np.repeat(begins[:-1], np.diff(rows)) if len(start) else np.zeros(0, np.int64)
    return out, rows, start - base, end - base


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive words each, by the place of the first; also across texts: cut them by the texts' offsets."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > len(_PLACES):
        return _long_gram_hashes(words, k)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += words[i : i + n] * _PLACES[i]
    return mixed(total)


def _long_gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The same for grams longer than the list of multipliers, as differences of running sums: the work does not grow with k."""
    power, inverse = _powers(len(words))
    sums = np.append(np.uint64(0), np.cumsum(words * power, dtype=np.uint64))
    return mixed((sums[k:] - sums[:-k]) * inverse[: len(words) - k + 1])
