"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240607)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random value for each byte; white space has none, A-Z those of a-z.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = [0x20, *range(0x09, 0x0E)]
_BYTE[_SPACE] = 0
_IS_WORD = _BYTE != 0
_BASE = int(_ODD(1)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _ODD(64)
_LENGTH = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each text (with the total at the end)."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    is_word = _IS_WORD[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & ~before)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    sums = np.add.reduceat(_BYTE[data] * _power(_BASE, len(data)), starts)
    return mixed(sums * _power(_INVERSE, len(data))[starts]), first


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text.

    A text with fewer words has its whole sequence as its one shingle; without words, none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size < 1 << 20):
            size += len(texts[upto] or b"")
            upto += 1
        words, first = word_hashes([t or b"" for t in texts[at:upto]])
        rolled = np.zeros(max(len(words) - k + 1, 0), np.uint64)
        for j in range(k):
            rolled += words[j : j + len(rolled)] * _PLACE[j]
        rolled = mixed(rolled + _LENGTH[k])
        for i in range(upto - at):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64)
                out.append(mixed(short + _LENGTH[b - a]))
            else:
                out.append(np.zeros(0, np.uint64))
        at = upto
    return out


def overlaps(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes, by products of incidence matrices."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if not n:
        return out
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]]) if len(every) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.zeros(0, bool)
    row, column = owner[order][shared], column[shared]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += (part @ part.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out
