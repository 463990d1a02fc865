"""Vectorised word and shingle hashing over batches of whole texts.

Words are runs of bytes other than space and \\t..\\r.  A batch is hashed in one
pass: every byte stands for a random number of a table by its place in the word, the sum
of which is the word's 64-bit hash (tabulation hashing: two words that differ collide with
2**-64, whatever their structure), and a weighted sum of five mixed word hashes gives
every window one.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Bytes of text hashed at a time, which bounds the working memory.
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_PLACES = 128
#: A random number for each byte value at each of _PLACES places.
_TABLE = mix(np.arange(_PLACES * 256, dtype=U64) * U64(_BASE) + U64(0x1F83D9ABFB41BD6B))


def unit_hashes(data: np.ndarray, start: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """A hash for each unit, from start[i] up to start[i + 1] or the end; bytes where counts is false are left out."""
    if not len(start):
        return np.zeros(0, U64)
    data, base = data[start[0]:], start - start[0]
    place = np.arange(len(data), dtype=np.int32) - np.repeat(base.astype(np.int32), np.diff(np.append(base, len(data))))
    value = _TABLE[((place & (_PLACES - 1)) << 8) | data]
    if counts is not None:
        value[~counts[start[0]:]] = 0
    far = np.flatnonzero(place >= _PLACES)
    with np.errstate(over="ignore"):
        if len(far):
            value[far] = np.where(value[far] == 0, U64(0), mix(value[far] + (place[far] // _PLACES).astype(U64) * U64(_BASE)))
        return mix(np.add.reduceat(value, base))


def words_of(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hashes of all words, and the offsets of each text's words (len + 1)."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    start = edge[0::2]
    return unit_hashes(data, start, word), np.concatenate(([0], np.searchsorted(start, ends)))


def windows_of(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n words (length len(words) - n + 1, or empty)."""
    if len(words) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(words) - n + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(n):
            total += words[j:len(words) - n + 1 + j] * U64((_BASE * (2 * j + 3) ** 7 | 1) & _MASK)
    return mix(total)


def chunks(texts: list[bytes]):
    """Slices (lo, hi) of consecutive texts of about CHUNK_BYTES together."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= CHUNK_BYTES:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingles, A-Z lower-cased.

    Fewer than n words: the whole sequence as one shingle; no words: empty.
    """
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        words, offset = words_of(texts[lo:hi], lower=True)
        window = windows_of(words, n)
        for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(window[a:b - n + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                out.append(windows_of(words[a:b], b - a))
            else:
                out.append(np.zeros(0, U64))
    return out
