"""Spelling variants of a corpus: words one edit apart, by dense prefix-suffix tiling.

Words that differ by one inserted, deleted or replaced code point have a common prefix and a
common suffix that together reach the longer length minus one.  So one of the two reaches half
of the shorter length, and only words that share such a half can meet.  All words of one half
(and of the two lengths in question) form a group; a group is cut into blocks of words, and each pair
of blocks is one tile: two padded code-point matrices, all of whose pairs are compared column
by column.  A large group becomes many tiles, which are dealt out over all tasks, so no group
meets in one task; a pair that shares both halves counts in the tile of its prefix alone.

Cases: a null text holds no words, and a null doc_id is written as nothing; equal counts go to
the least word in code-point order; words without a near word have no form and are their own
root; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

_RUN = rb"[a-z\xc0-\xff]{%d,}"
#: Distinct words that one task counts before it passes them on; code points searched at a time.
_HELD, _SLICE = 300_000, 1_000_000
#: Words in a block; a tile compares up to its square of pairs.
BLOCK = 1024


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in slices that don't cut a run."""
    lo = 0
    while len(text) - lo > _SLICE:
        edge = re.compile(rb"[^a-z\xc0-\xff]").search(text, lo + _SLICE)
        hi = edge.start() if edge else len(text)
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def _counter(least: int, drop: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partial counts of words of (doc_id, text); drop: runs whose hash it divides lose a code point.

    Letters are those of Latin-1, so a text is searched as Latin-1 bytes, one for each code point.
    """
    rx = re.compile(_RUN % least)

    def emit(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                own: Counter[bytes] = Counter()
                for part in _slices(text.as_py().encode("latin-1", "replace").lower()):
                    own.update(rx.findall(part))
                if drop:
                    seed = zlib.crc32(f"{doc_id.as_py() if doc_id.is_valid else ''}:".encode())
                    for w in list(own):
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                        if h % drop == 0:
                            n, at = own.pop(w), h % len(w)
                            short = w[:at] + w[at + 1:]
                            if len(short) >= least:
                                counts[short] += n
                counts.update(own)
                if len(counts) >= _HELD:
                    yield emit(counts)
                    counts.clear()
        if counts:
            yield emit(counts)

    return run


def corpus_words(docs: DataFrame, least_length: int = 6, least_n: int = 5, drop: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters of all texts, A-Z lower-cased, with at least least_n occurrences."""
    parts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(_counter(least_length, drop), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _matrix(words: list[str], width: int) -> np.ndarray:
    """Code points of the words, padded with zeros, in the smallest type that holds them; one word a column."""
    cells = np.zeros((len(words), width), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    cells[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.uint8 if not cells.size or cells.max() < 256 else np.uint32
    return np.ascontiguousarray(cells.T.astype(kind))


def _common(a: np.ndarray, b: np.ndarray, known: int, most: int) -> np.ndarray:
    """Lengths of the common prefixes of every column of a with every one of b, of which `known` is given."""
    out = np.full((a.shape[1], b.shape[1]), known, np.uint8 if most < 256 else np.int32)
    alive = np.ones(out.shape, bool)
    for c in range(known, most):
        alive &= a[c][:, None] == b[c][None, :]
        if not alive.any():
            break
        out += alive
    return out


def single_edits(a: list[str], b: list[str], half: int, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of pairs one edit apart; a's words have one length, b's that or one more.

    All share a prefix of `half` code points, or (prefix false) a suffix, and then only pairs whose common
    prefix is shorter count.
    """
    short, long = len(a[0]), len(b[0])
    front = _common(_matrix(a, short), _matrix(b, long), half if prefix else 0, short)
    back = _common(_matrix([w[::-1] for w in a], short), _matrix([w[::-1] for w in b], long), 0 if prefix else half, short)
    near = front.astype(np.int32) + back >= long - 1
    if short == long:
        near &= front < short  # equal words
    if not prefix:
        near &= front < half
    return np.nonzero(near)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, word, n), sorted by tile, to pairs of near words both ways."""
    held: list[tuple] = []
    out: list[tuple] = []
    size, tile = 0, None

    def pairs() -> None:
        nonlocal size
        (_, prefix, length, i, j), rows = tile, held
        sides = [[(w, n) for k, w, n in rows if k in (s, 2)] for s in (0, 1)]
        for longer in (0, 1):
            for x, y in ((0, 1), (1, 0))[:1 if i == j else 2]:
                if not longer and (x, y) == (1, 0):
                    continue  # of one length: each pair of blocks once
                a = [r for r in sides[x] if len(r[0]) == length]
                b = [r for r in sides[y] if len(r[0]) == length + longer]
                if not a or not b:
                    continue
                at, to = single_edits([w for w, _ in a], [w for w, _ in b], length // 2, prefix)
                if not longer and i == j:
                    at, to = at[at < to], to[at < to]
                if len(at):
                    aw, an, bw, bn = ([r[k] for r in side] for side in (a, b) for k in (0, 1))
                    aw, bw, an, bn = pa.array(aw, pa.string()), pa.array(bw, pa.string()), pa.array(an, pa.int64()), pa.array(bn, pa.int64())
                    out.append((aw.take(pa.array(at)), bw.take(pa.array(to)), bn.take(pa.array(to))))
                    out.append((bw.take(pa.array(to)), aw.take(pa.array(at)), an.take(pa.array(at))))
                    size += 2 * len(at)

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], ["word", "near", "near_n"])

    for batch in batches:
        tiles = batch.column(0).to_pylist()
        for t, side, word, n in zip(tiles, *(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            key = (t["half"], t["prefix"], t["length"], t["i"], t["j"])
            if key != tile:
                if held:
                    pairs()
                    held.clear()
                    if size >= 200_000:
                        yield emit()
                        out.clear()
                        size = 0
                tile = key
            held.append((side, word, n))
    if held:
        pairs()
    if out:
        yield emit()


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for all words (word, n) one edit apart, both ways."""
    w = words.select("word", "n", F.length("word").alias("m"))
    half = lambda prefix, shorter: F.expr(f"left(word, (m - {shorter}) div 2)" if prefix else f"right(word, (m - {shorter}) div 2)")
    key = lambda prefix, shorter: F.struct(half(prefix, shorter).alias("half"), F.lit(prefix).alias("prefix"), (F.col("m") - shorter).alias("length"))
    keyed = w.select("word", "n", F.explode(F.array(*[key(p, s) for p in (True, False) for s in (0, 1)])).alias("g")).where("g.length > 0")
    counts = keyed.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    counts = counts.select("g", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    placed = keyed.join(counts, "g").withColumn("b", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # a word goes to the tiles of its block with every block: as first (0), as second (1), or as both (2)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    tiles = placed.select("g", "word", "n", "b", other).select(
        F.struct("g.half", "g.prefix", "g.length", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")).alias("tile"),
        F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"), "word", "n")
    dealt = tiles.repartition(partitions(words.sparkSession), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(_tiles, "word string, near string, near_n long")


def spelling_forms(words: DataFrame, times: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n).

    The form is the most frequent near word, if it is at least `times` as frequent; times is
    2 or more, so chains of forms end after a few steps.  Roots are found by joins that double the
    steps made.
    """
    words = materialize(words.select("word", "n"), "words")
    near = near_pairs(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    has = -F.col("best.rank") >= times * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.rank")).alias("form_n"))
    joined = materialize(joined, "forms")
    roots = materialize(joined.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = materialize(roots.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            break
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
