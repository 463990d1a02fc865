"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is cut into fragments of the hash space.  Each document's
shingle set is cut the same way, so a fragment sees one segment of every set and can
count, alone, the partial overlaps that fall in it; partial counts are then summed,
once per document and once per pair:

1. per document: in its fragment a shingle that a second, different set also holds is
   *shared*.  Summed over fragments, a document with fewer shared shingles than 80 %
   of its set can link with nothing and leaves (exact: overlap >= 0.8 * own size).
2. per pair: the rest order their shingles by (document frequency, hash) and meet in
   the buckets of their prefixes of n - ceil(0.8 n) + 1 shingles.  Candidate pairs go
   to all fragments, which count their partial overlaps; the sum decides the link.

Copies share one representative (equal 128-bit digest of the set) and are never
paired.  Inside a bucket the documents are first compared with one centre only; pairs
whose ends are by then in the same component need no test, and pairs that the triangle
inequality of the Jaccard distance rules out are not tested either, so a bucket of n
near copies costs about n comparisons and not n * n, while every remaining pair that
could join two components is counted exactly.

Defined results: null or word-less text has an empty set and links with nothing; a
null id is returned with a null component; fewer than n words form one shingle;
doc_id is expected to be unique (repeated rows with one id give repeated rows, and
count as one document).  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import steps, text_bytes
from .common import connected_components, materialize, partitions
from .hashing import mix, shingle_sets
from .packing import pack, pack_sorted, rows_batch, unpack, unpack_sorted

U64 = np.uint64
_SEGMENTS = "frag int, batch long, idx binary, sh binary"
_SHARED = "batch long, idx binary, sh binary, df binary"
_PAIR_SEGMENTS = "frag int, docs binary, cnt binary, n_others binary, others binary, sh binary"
#: Text bytes whose sets are cut together.
_STEP = 6 << 20
#: Ids in the lists of pairs that are broadcast; beyond, the join is shuffled.
MAX_BROADCAST_IDS = 500_000


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set: two independent sums of its mixed members."""
    with np.errstate(over="ignore"):
        a = mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
        b = mix(s * U64(0xD6E8FEB86659FD93)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _digests(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(text_bytes(batch), words)
            d = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64())],
                ["doc_id", "n_shingles", "sig_a", "sig_b"])

    return run


def _pivots(fragments: int) -> np.ndarray:
    """Where the order is cut: hash ranges of equal width."""
    return (np.arange(1, fragments, dtype=np.float64) * (2.0**64 / fragments)).astype(U64)


def _segments(words: int, fragments: int):
    """Cut the sets of a batch; one row per batch and fragment holds all its segments.

    A set is named by its place in the batch; the batch's ids and set sizes go on, as a
    row of a fragment number past the others, to where the batch's counts are summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(steps(batches, size=_STEP)):
            ids = batch.column("doc_id").to_pylist()
            first: dict[tuple, int] = {}
            sets = shingle_sets(text_bytes(batch), words)
            for i, s in enumerate(sets):  # copies inside the batch: only the smallest id goes on
                if len(s) and ids[i] is not None:
                    k = (*_digest(s), len(s))
                    if k not in first or ids[i] < ids[first[k]]:
                        first[k] = i
            keep = sorted(first.values())
            if not keep:
                continue
            size = np.array([len(sets[i]) for i in keep], np.int64)
            sh, idx = np.concatenate([sets[i] for i in keep]), np.repeat(np.arange(len(keep), dtype=np.uint32), size)
            order = np.argsort(sh, kind="stable")
            sh, idx = sh[order], idx[order]
            at = np.concatenate(([0], np.searchsorted(sh, _pivots(fragments)), [len(sh)])).tolist()
            rows = [(f, task + number, pack(idx[lo:hi]), pack_sorted(sh[lo:hi])) for f, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
            rows.append((fragments + number % fragments, task + number, np.array([ids[i] for i in keep], np.int64).tobytes(), size.tobytes()))
            for lo in range(0, len(rows), 128):
                yield rows_batch(rows[lo:lo + 128], _SEGMENTS)

    return run


def _shared(fragments: int):
    """Of one fragment: the postings of shingles that at least two sets hold.

    Copies that lie in different batches count as two sets here; that keeps their
    representative in, never anything out.
    """

    def run(table: pa.Table) -> pa.Table:
        frag, batch, idx, sh = (table.column(c).to_pylist() for c in ("frag", "batch", "idx", "sh"))
        if frag[0] >= fragments:
            rows = [(b, i, n, None) for b, i, n in zip(batch, idx, sh, strict=True)]
        else:
            own = [unpack_sorted(x) for x in sh]
            del sh
            flat = np.concatenate(own)
            order = np.argsort(flat, kind="stable")
            s = flat[order]
            start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            length = np.diff(np.append(start, len(s)))
            df = np.zeros(len(s), np.uint32)
            df[order] = np.repeat(length, length)
            rows, lo = [], 0
            for b, i, x in zip(batch, idx, own, strict=True):
                d = df[lo:lo + len(x)]
                lo += len(x)
                m = d > 1
                if m.any():
                    rows.append((b, pack(unpack(i, np.uint32)[m]), pack_sorted(x[m]), pack(d[m])))
        if rows:
            return pa.Table.from_batches([rows_batch(rows, _SHARED)])
        return pa.schema([("batch", pa.int64()), ("idx", pa.binary()), ("sh", pa.binary()), ("df", pa.binary())]).empty_table()

    return run


def _survivors(percent: int):
    """Of one batch of documents: those that could link, with their prefixes."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("idx", "sh", "df")), strict=True))
        ids, n = next((np.frombuffer(i, np.int64), np.frombuffer(s, np.int64)) for i, s, d in rows if d is None)
        rows = [r for r in rows if r[2] is not None]
        out = []
        if rows:
            who = np.concatenate([unpack(i, np.uint32) for i, _, _ in rows])
            sh = np.concatenate([unpack_sorted(s) for _, s, _ in rows])
            df = np.concatenate([unpack(d, np.uint32) for _, _, d in rows])
            ok = 100 * np.bincount(who, minlength=len(ids)) >= percent * n
            keep = ok[who]
            who, sh, df = who[keep], sh[keep], df[keep]
            order = np.lexsort((sh, df, who))
            who, sh = who[order], sh[order]
            at = np.searchsorted(who, np.arange(len(ids) + 1))
            for i in np.flatnonzero(ok).tolist():
                own = sh[at[i]:at[i + 1]]
                alone = int(n[i] - len(own))  # in no other set, so first in the order
                prefix = int(n[i] - -(-percent * n[i] // 100) + 1) - alone
                out.append((int(ids[i]), int(n[i]), alone, own[:prefix].view(np.int64), np.sort(own).tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "n", "alone", "prefix", "sh"])

    return run


def _pair_segments(fragments: int):
    """Cut documents' shared shingles, with the centres that they are compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "sh"):
            sets = [np.frombuffer(x, U64) for x in batch.column("sh").to_pylist()]
            docs = np.array(batch.column("doc").to_pylist(), np.int64)
            others = [np.array(o or [], np.int64) for o in batch.column("others").to_pylist()]
            sh, idx = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            cut = np.searchsorted(_pivots(fragments), sh, side="right")
            order = np.lexsort((sh, idx, cut))
            sh, idx = sh[order], idx[order]
            at = np.searchsorted(cut[order], np.arange(fragments + 1)).tolist()
            rows = []
            for f, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if hi > lo:
                    own, cnt = np.unique(idx[lo:hi], return_counts=True)
                    lists = [others[i] for i in own.tolist()]
                    rows.append((f, docs[own].tobytes(), cnt.astype(np.int64).tobytes(), np.array([len(o) for o in lists], np.int64).tobytes(), np.concatenate(lists).tobytes(), sh[lo:hi].tobytes()))
            for lo in range(0, len(rows), 64):
                yield rows_batch(rows[lo:lo + 64], _PAIR_SEGMENTS)

    return run


def _partial_overlaps(table: pa.Table) -> pa.Table:
    """Of one fragment: for each candidate pair, how many of its shingles both hold."""
    docs, n, n_others, b_id = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("docs", "cnt", "n_others", "others"))
    flat = np.frombuffer(b"".join(table.column("sh").to_pylist()), U64)
    base = np.cumsum(n) - n
    order = np.argsort(docs)
    a = np.repeat(np.arange(len(docs)), n_others)
    at = np.minimum(np.searchsorted(docs[order], b_id), len(docs) - 1)
    here = docs[order][at] == b_id
    a, b = a[here], order[at[here]]
    swap = n[a] > n[b]  # look the shorter segment up in the longer one
    short, long = np.where(swap, b, a), np.where(swap, a, b)
    salt = mix(np.arange(len(docs), dtype=U64))
    index = np.sort(mix(flat ^ np.repeat(salt, n)))
    out = np.zeros(len(a), np.int64)
    step = max(1, 1_000_000 // max(1, int(n.mean())))
    for lo in range(0, len(a), step):
        s, g = short[lo:lo + step], long[lo:lo + step]
        c = n[s]
        take = np.repeat(base[s] - np.cumsum(c) + c, c) + np.arange(c.sum())
        key = mix(flat[take] ^ np.repeat(salt[g], c))
        found = index[np.minimum(np.searchsorted(index, key), len(index) - 1)] == key
        out[lo:lo + step] = np.bincount(np.repeat(np.arange(len(s)), c), found, len(s))
    some = out > 0
    return pa.table({"a": pa.array(docs[a[some]]), "b": pa.array(docs[b[some]]), "part": pa.array(out[some])})


def _overlaps(sets: DataFrame, sizes: DataFrame, pairs: DataFrame, fragments: int) -> DataFrame:
    """(a, b, n_a, n_b, overlap) of candidate pairs: partial counts, summed per pair."""
    both = pairs.select(F.col("a").alias("doc"), "b").unionAll(pairs.select(F.col("b").alias("doc"), F.lit(None).cast("long").alias("b")))
    lists = materialize(both.groupBy("doc").agg(F.collect_list("b").alias("others")), "lists")
    if lists.agg(F.count("*") + F.coalesce(F.sum(F.size("others")), F.lit(0))).first()[0] <= MAX_BROADCAST_IDS:
        lists = F.broadcast(lists)  # the sets themselves are then not shuffled for it
    rows = sets.select("doc", "sh").join(lists, "doc")
    parts = rows.mapInArrow(_pair_segments(fragments), _PAIR_SEGMENTS)
    parts = parts.groupBy("frag").applyInArrow(_partial_overlaps, "a long, b long, part long")
    size = sizes.select("doc", "n")
    return (parts.groupBy("a", "b").agg(F.sum("part").alias("overlap"))
            .join(size.withColumnsRenamed({"doc": "a", "n": "n_a"}), "a").join(size.withColumnsRenamed({"doc": "b", "n": "n_b"}), "b"))


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, fragments: int | None = None, star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, rep_id (smallest id with the same set), component_id.

    Two sets link when 100 * intersection >= percent * union.  fragments defaults to
    four for each shuffle partition, so that a fragment's share of the corpus stays the
    same as the session's owner raises the number of partitions with the data.
    star_rounds only bounds the rounds of one-centre comparisons before the pairs that
    are still undecided are counted; no result depends on it.
    """
    spark = docs.sparkSession
    shuffle = partitions(spark)
    fragments = fragments or 4 * shuffle
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digests = materialize(docs.mapInArrow(_digests(words), "doc_id long, n_shingles long, sig_a long, sig_b long"), "digests")
    reps = digests.where("n_shingles > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    member = digests.join(reps, ["sig_a", "sig_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep_id"))

    segments = docs.mapInArrow(_segments(words, fragments), _SEGMENTS)
    shared = segments.groupBy("frag").applyInArrow(_shared(fragments), _SHARED)
    sets = materialize(shared.groupBy("batch").applyInArrow(_survivors(percent), "doc long, n long, alone long, prefix array<long>, sh binary"), "survivors")
    # of copies in different batches one stays; the long column stays out of this join
    sizes = materialize(sets.select("doc", "n", "alone", "prefix").join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi"), "sizes")

    postings = materialize(sizes.select("doc", "n", (F.col("alone") / F.col("n")).alias("own"), "alone", F.posexplode("prefix").alias("i", "s")).select("s", "doc", "n", "own", (F.col("alone") + F.col("i")).alias("before")), "postings")
    tested = edges = None
    component = postings.select("doc", F.col("doc").alias("c")).distinct()
    for turn in range(star_rounds + 1):
        held = postings.join(component, "doc") if turn else postings.withColumn("c", F.col("doc"))
        if turn < star_rounds:
            # in each bucket, by size class: the document with the fewest shingles of its own is the centre
            held = held.withColumn("size", _size_class("n", percent, turn))
            best = held.groupBy("s", "size").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi"), F.min(F.struct("own", "n", "doc", "before", "c")).alias("best")).where("c_lo < c_hi")
            centre = best.select("s", "size", *(F.col(f"best.{x}").alias(f"b_{x}") for x in ("doc", "n", "before", "c")))
            pairs = held.join(centre, ["s", "size"]).where((F.col("c") != F.col("b_c")) & _possible("n", "before", "b_n", "b_before", percent)).select(F.col("doc").alias("u"), F.col("b_doc").alias("v"))
        else:
            pairs = _undecided(held, tested, percent)
        # one row a pair; it is listed at the end that isn't the centre, so no list is long
        pairs = pairs.groupBy(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min("u").alias("a"))
        if tested is not None:
            pairs = pairs.join(tested.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), ["lo", "hi"], "left_anti")
        pairs = pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            if turn < star_rounds:
                continue
            break
        counted = materialize(_overlaps(sets, sizes, pairs, max(8, shuffle // 4)), "overlaps")
        tested = counted if tested is None else tested.unionAll(counted)
        edges = tested.where(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")
        found = connected_components(edges)
        component = materialize(component.join(found, component.doc == found.id, "left").select("doc", F.coalesce("component", "doc").alias("c")), "component")
    label = component.select(F.col("doc").alias("rep_id"), F.col("c").alias("component_id"))
    return member.join(label, "rep_id", "left").select("doc_id", "n_shingles", "rep_id", F.coalesce("component_id", "rep_id").alias("component_id"))


def _size_class(n: str, percent: int, turn: int):
    """Sizes that can link share a class, or are at most one apart; odd turns shift the classes by half."""
    return F.floor(F.log(F.col(n)) / F.log(F.lit(100.0 / percent)) + 0.5 * (turn % 2))


def _possible(n_u: str, before_u: str, n_v: str, before_v: str, percent: int):
    """Whether two sets can link whose first common shingle has so many before it in either.

    Asked in a bucket of a later common shingle it may say no, but never in the first.
    """
    most = F.least(F.col(n_u) - F.col(before_u), F.col(n_v) - F.col(before_v))
    return 100 * most >= percent * (F.col(n_u) + F.col(n_v) - most)


def _undecided(held: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Pairs of one bucket and two components that sizes and distances don't rule out.

    With a first centre x of both, |d(u, x) - d(v, x)| <= d(u, v) for the Jaccard
    distance d, so pairs that differ by more than the allowed distance aren't candidates.
    """
    mixed = held.groupBy("s").agg(F.min("c").alias("c_lo"), F.max("c").alias("c_hi")).where("c_lo < c_hi").select("s")
    held = held.join(mixed, "s", "left_semi").withColumn("size", _size_class("n", percent, 0))
    first = held.groupBy("s", "size").agg(F.min(F.struct("own", "n", "doc", "before", "c")).alias("best")).select("s", "size", F.col("best.doc").alias("x"))
    rows = held.join(first, ["s", "size"])
    if tested is None:
        tested = held.select(F.col("doc").alias("a"), F.col("doc").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("overlap")).where("false")
    known = tested.select("a", "b", (1 - F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))).alias("d"))
    known = known.unionAll(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    rows = rows.join(known, (rows.doc == known.a) & (rows.x == known.b), "left").select(
        "s", "doc", "n", "before", "c", "x", F.when(F.col("doc") == F.col("x"), 0.0).otherwise(F.col("d")).alias("d"))
    u, v = rows.alias("u"), rows.alias("v")
    near = (F.col("u.x") != F.col("v.x")) | F.coalesce(F.abs(F.col("u.d") - F.col("v.d")) <= (100 - percent) / 100 + 1e-9, F.lit(True))
    both = u.join(v, (F.col("u.s") == F.col("v.s")) & (F.col("u.doc") < F.col("v.doc")) & (F.col("u.c") != F.col("v.c"))
                  & _possible("u.n", "u.before", "v.n", "v.before", percent) & near)
    return both.select(F.col("u.doc").alias("u"), F.col("v.doc").alias("v"))
