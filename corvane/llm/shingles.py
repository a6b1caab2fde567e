"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_EMPTY = np.empty(0, np.uint64)
#: Bytes hashed at once; a word is never cut.
BLOCK = 1 << 19
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte, A-Z as a-z, and an odd base with its inverse modulo 2^64.
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0xA0761D6478BD642B
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (_EMPTY, _EMPTY)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base and inverse; those of usual blocks are kept."""
    global _powers
    if len(_powers[0]) > n:
        return _powers
    size = max(n, BLOCK + (BLOCK >> 3)) + 1
    both = []
    for b in (_BASE, _INVERSE):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p, out=p))
    if size <= 4 * BLOCK:
        _powers = both[0], both[1]
    return both[0], both[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _block_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of one block: differences of prefix sums of byte times power, moved to power 0."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers_to(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts]), starts


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words between ASCII white space, with A-Z as a-z; equal words have equal hashes wherever they are."""
    whole, at, found = np.frombuffer(data, np.uint8), 0, []
    while at < len(whole):
        to = min(len(whole), at + BLOCK)
        if to < len(whole):  # up to the next white space
            step = 256
            while to < len(whole):
                gap = np.flatnonzero(_SPACE[whole[to : to + step]])
                if len(gap):
                    to += int(gap[0])
                    break
                to, step = min(len(whole), to + step), step * 2
        h, s = _block_hashes(whole[at:to])
        found.append((h, s + at))
        at = to
    if not found:
        return _EMPTY, np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def sets_of(texts: Sequence[str | None], width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text; a text with fewer words has its whole sequence as one shingle, none without words."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    h, starts = _word_hashes(b"\n".join(coded))
    upto = np.cumsum([len(c) + 1 for c in coded])
    ends = np.searchsorted(starts, upto).tolist()
    m = h[: max(0, len(h) - width + 1)].copy()
    for i in range(1, width):
        m *= _P1
        m += h[i : len(h) - width + 1 + i]
    m = _mixed(m)
    at = 0
    for end in ends:
        n = end - at
        if not n:
            yield _EMPTY
        elif n < width:
            yield np.array([xxhash.xxh3_64_intdigest(h[at:end].tobytes(), seed=n)], np.uint64)
        else:
            s = np.sort(m[at : end - width + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        at = end


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
