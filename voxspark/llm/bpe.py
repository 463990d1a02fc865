"""Byte-level BPE encoding and decoding with padded numpy matrices.

A text is cut into units where no match of the splitting pattern crosses (unit_starts),
so only the distinct units of a batch are split by the pattern and encoded.  Distinct pieces go to matrices by length bucket, one row of
byte ids a piece, padded on the right.  In each round every row merges its leftmost
pair of least rank, found by a hashed look-up of (left id, right id); rows without a
mergeable pair leave and the matrix is compacted.  Pieces that are themselves in the
vocabulary keep their own id, as the tiktoken library does.

Defined results: null text counts as empty and gives no ids and no bytes; a piece of
any length is merged exactly; decoding concatenates the bytes of the ids, and an id
outside of the vocabulary, or a null one, raises an error.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import steps, text_bytes
from .hashing import unit_hashes

#: Units whose ids a worker keeps from batch to batch.
CACHE_UNITS = 800_000
#: Text bytes that are coded at a time.
UNIT_STEP = 1_000_000
_BYTE = np.arange(256)
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_GRAPH = (_BYTE > 0x20) & (_BYTE < 0x7F)
_PUNCT = _GRAPH & ~_ALNUM
#: First bytes of characters that no engine takes for white space.
_SOLID = _GRAPH | (_BYTE >= 0xC3) & ~np.isin(_BYTE, [0xE1, 0xE2, 0xE3, 0xEF])


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Places where no match of the splitting pattern crosses.

    Before a space that a solid character follows, between an ASCII letter or digit and
    ASCII punctuation, and between a lone newline after a visible character and an
    ASCII letter or digit.
    """
    cut = np.zeros(len(data), bool)
    cut[:-1] |= (data[:-1] == 0x20) & _SOLID[data[1:]]
    cut[1:] |= _ALNUM[data[:-1]] & _PUNCT[data[1:]]
    cut[2:] |= _GRAPH[data[:-2]] & (data[1:-1] == 0x0A) & _ALNUM[data[2:]]
    return cut


class UnitCoder:
    """Ids of texts from the ids of their distinct units, which are kept for later batches.

    Units are known by 64-bit hashes in an open-addressing table; only new ones become
    strings, which encode_words turns into ids.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]]):
        self.encode_words = encode_words
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.keys = np.zeros(0, np.uint64)
        self._build(1 << 16)

    def _build(self, slots: int) -> None:
        self.shift, self.mask = np.uint64(65 - slots.bit_length()), slots - 1
        self.slot_key, self.slot_code = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self._insert(self.keys, np.arange(len(self.keys), dtype=np.int32))

    def _insert(self, keys: np.ndarray, codes: np.ndarray) -> None:
        slot, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.slot_code[slot[left]] < 0
            tried = left[free]
            self.slot_code[slot[tried]] = codes[tried]  # of several, the last one stays
            won = self.slot_code[slot[left]] == codes[left]
            self.slot_key[slot[left[won]]] = keys[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        rows, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(rows):
            code = self.slot_code[slot]
            hit = (code >= 0) & (self.slot_key[slot] == keys[rows])
            out[rows[hit]] = code[hit]
            on = ~hit & (code >= 0)
            rows, slot = rows[on], (slot[on] + 1) & self.mask
        return out

    def _trim(self) -> None:
        """Keep the half that came first, as frequent units come early."""
        half = CACHE_UNITS // 2
        self.size, self.start, self.keys = self.size[:half].copy(), self.start[:half].copy(), self.keys[:half].copy()
        self.flat = self.flat[:self.start[-1] + self.size[-1]].copy()
        self._build(len(self.slot_key))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one after the other, and offsets (len + 1)."""
        if len(self.keys) > CACHE_UNITS:
            self._trim()
        ends = np.cumsum([len(t) for t in texts])
        raw = b"".join(texts)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        at = _starts_within(data, unit_starts(data), ends)
        stop = np.append(at[1:], len(data))
        keys = unit_hashes(data, at)
        code = self._find(keys)
        new = np.flatnonzero(code < 0)
        if len(new):
            fresh, where, back = np.unique(keys[new], return_index=True, return_inverse=True)
            order = np.argsort(where)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            places = new[where[order]]
            ids = self.encode_words([raw[a:b].decode() for a, b in zip(at[places].tolist(), stop[places].tolist(), strict=True)])
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            base = len(self.keys)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size, dtype=np.int64) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))))
            self.keys = np.concatenate((self.keys, fresh[order]))
            code[new] = base + rank[back]
            if 2 * len(self.keys) > len(self.slot_key):
                self._build(1 << (4 * len(self.keys)).bit_length())
            else:
                self._insert(fresh[order], np.arange(base, base + len(order), dtype=np.int32))
        size = self.size[code].astype(np.int64)
        stops = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[code] - stops + size, size) + np.arange(int(stops[-1]))]
        return ids, np.concatenate(([0], stops))[np.concatenate(([0], np.searchsorted(at, ends)))]


def _starts_within(data: np.ndarray, cut: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unit starts of joined texts; where a rule saw characters of two texts, it is undone."""
    first = ends[ends < len(data)]
    for shift in (-1, 0, 1):
        p = first + shift
        p = p[(p >= 0) & (p < len(data))]
        cut[p] = False
    cut[first] = True
    cut[0] = True
    return np.flatnonzero(cut)


class PairTable:
    """Open addressing from (left id, right id) to the id of both together."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, PairTable.NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            tried = left[free]
            self.keys[slot[tried]] = keys[tried]  # of several, the last one stays
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask

    NONE = np.int32(2**31 - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs, NONE where they don't merge (padding is negative)."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        out = np.full(len(keys), PairTable.NONE, np.int32)
        rows = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[rows])
        while len(rows):
            held = self.keys[slot]
            hit = held == keys[rows]
            out[rows[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            rows, slot = rows[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class ByteBpe:
    """A rank file: encode_words() gives the ids of strings, decode() the bytes of ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        table = np.array(pairs, np.int64).reshape(-1, 2)
        self.table = PairTable(table[:, 0], table[:, 1].astype(np.int32))
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.token_size = np.array([len(t) for t in self.token], np.int64)
        self.token_flat = np.frombuffer(b"".join(self.token), np.uint8)
        self.token_start = np.cumsum(self.token_size) - self.token_size

    def encode_words(self, words: list[str]) -> list[list[int]]:
        split = [self.pattern.findall(w) for w in words]
        ids = self.encode_pieces(list({p for s in split for p in s}))
        return [[i for p in s for i in ids[p]] for s in split]

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                out[p] = [whole]
            else:
                n = len(b)
                width = n if n <= 8 else -(-n // 4) * 4 if n <= 32 else 1 << (n - 1).bit_length()
                buckets.setdefault(width, []).append((p, b))
        for width, own in buckets.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(own), step):
                part = own[lo:lo + step]
                for (p, _), ids in zip(part, self._merge([b for _, b in part]), strict=True):
                    out[p] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        size = np.array([len(b) for b in pieces])
        width = int(size.max())
        at = np.arange(width)
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[at < size[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.table.look_up(ids[:, :-1], ids[:, 1:])
        row, out = np.arange(len(pieces)), [None] * len(pieces)
        while len(row):
            best = rank.argmin(axis=1)  # the first of equals: the leftmost
            least = rank[np.arange(len(row)), best]
            done = least == PairTable.NONE
            if done.any():
                for i, r, n in zip(row[done].tolist(), ids[done].tolist(), size[done].tolist(), strict=True):
                    out[i] = r[:n]
                on = ~done  # compaction, of rows and then of columns that are padding in all
                row, ids, rank, size, best, least = row[on], ids[on], rank[on], size[on], best[on], least[on]
                if not len(row):
                    break
                width = int(size.max())
                ids, rank = ids[:, :width], rank[:, :width - 1]
            every = np.arange(len(row))
            if len(row) == 1:
                b = int(best[0])
                ids = np.concatenate((ids[:, :b + 1], ids[:, b + 2:]), axis=1)
                rank = np.concatenate((rank[:, :b], rank[:, b + 1:]), axis=1)
                width -= 1
            else:
                after = at[None, :width - 1] + (at[None, :width - 1] > best[:, None])
                ids[:, :-1] = np.take_along_axis(ids, after, axis=1)
                ids[:, -1] = -1
                if width > 2:
                    rank[:, :-1] = np.take_along_axis(rank, at[None, :width - 2] + (at[None, :width - 2] >= best[:, None]), axis=1)
                rank[:, -1] = PairTable.NONE
            ids[every, best] = least
            size -= 1
            for side in (best - 1, best):  # the two pairs that hold the new id
                ok = (side >= 0) & (side + 1 < width)
                r, s = every[ok], side[ok]
                rank[r, s] = self.table.look_up(ids[r, s], ids[r, s + 1])
            if width == 1:
                rank = np.full((len(row), 1), PairTable.NONE, np.int32)
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token) or not self.token_size[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.token_size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        data = self.token_flat[np.repeat(self.token_start[ids] - ends + size, size) + np.arange(total)].tobytes()
        cut = np.concatenate(([0], ends))[offsets].tolist()
        return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


_held: dict[tuple[str, str], tuple[ByteBpe, UnitCoder]] = {}


def _coder(path: str, pattern: str) -> tuple[ByteBpe, UnitCoder]:
    """Of this worker, for all its batches."""
    if (path, pattern) not in _held:
        bpe = ByteBpe(path, pattern)
        _held[path, pattern] = (bpe, UnitCoder(bpe.encode_words))
    return _held[path, pattern]


def list_column(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the text column replaced by its ids (array<int>)."""
    others = [c for c in docs.columns if c != text]
    schema = docs.select(*others, F.array(F.lit(1)).cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = _coder(path, pattern)
        for batch in steps(batches, text, UNIT_STEP):
            flat, offsets = coder.encode(text_bytes(batch, text))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), list_column(flat, offsets)], [*others, ids])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column of the bytes that its ids stand for (null ids: no bytes)."""
    names = df.columns
    schema = df.select("*", F.lit(b"").cast("binary").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _coder(path, pattern)
        for batch in steps(batches, ids):
            lists = batch.column(batch.schema.get_field_index(ids))
            size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            data = bpe.decode(np.asarray(lists.flatten(), np.int64), np.concatenate(([0], np.cumsum(size))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*names, out])

    return df.mapInArrow(run, schema)
