"""Exact top-k BM25 search with block-max WAND pruning.

Every step of documents becomes a shard: an inverted index with postings in blocks of
`BLOCK` documents (documents with the same most frequent word stand together, which
keeps block maxima apart).  Document frequencies are summed over all shards in fragments
of the term space, where the queries' terms pick theirs up; so every shard scores with the
same global statistics and the shards' top-k lists merge exactly.

Queries go in blocks of at most QUERY_BLOCK_WORDS terms, each broadcast to the tasks that
read the index; the index itself is written once and never shuffled.  First passes over
one shard in 32 and one in 8 give every query a global threshold, its k-th score there.  Then,
for a query and a shard, terms whose bounds add up to less than the threshold (those of
most postings for their bound first: the WAND pivot) can't lift a document over it alone.
Only the other terms are walked: their block maxima and the rest's bound choose the blocks
to open, in those their postings choose the documents, and only these are looked up
in the remaining terms.  A shard whose bounds stay below the threshold is skipped.

Score: sum over terms of qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), rounded to 6 decimals; ties go to the smaller
doc_id.  Words are runs of other than space and \\t..\\r, A-Z lower-cased.

Defined results: null text counts as empty; a query without words, or whose words are
in no document, has no rows; rows with a null id are neither found nor asked; rows that
repeat an id are found each; queries that share a query_id are asked together, as one text; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import steps, text_bytes
from .common import materialize, partitions
from .hashing import chunks, words_of
from .packing import pack, pack_sorted, rows_batch, unpack, unpack_sorted

BLOCK = 16
#: Text bytes of a shard, and distinct words of its queries (added up) of a query block.
SHARD_BYTES, QUERY_BLOCK_WORDS = 6 << 20, 1_500_000
#: First one shard in 32 sets thresholds, then one in 8 sharper ones, for all others.
SEED_SHARDS = (32, 8)
#: Scores are sums in different orders; bounds leave them so much room.
_SLACK = 1e-5
_INDEX = "shard long, n_docs long, n_words long, docs binary, lens binary, terms binary, dfs binary, post_doc binary, post_tf binary"


def _term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """term, text number, count of all pairs in order of (term, text), and words per text."""
    # hashed in small chunks, as the tables of a chunk are many times its size
    some = [words_of(texts[lo:hi], lower=True) for lo, hi in chunks(texts)] or [(np.zeros(0, np.uint64), np.zeros(1, np.int64))]
    words, n = np.concatenate([w for w, _ in some]), np.concatenate([np.diff(at) for _, at in some])
    text = np.repeat(np.arange(len(texts)), n)
    order = np.argsort(words, kind="stable")
    words, text = words[order], text[order]
    start = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (text[1:] != text[:-1])))) if len(words) else np.zeros(0, np.int64)
    return words[start], text[start], np.diff(np.append(start, len(words))), n


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << 32
    for number, batch in enumerate(steps(batches, size=SHARD_BYTES)):
        docs, texts = np.array(batch.column("doc_id").to_pylist(), np.int64), text_bytes(batch)
        term, text, tf, n = _term_counts(texts)
        # documents with the same most frequent word next to each other, then by length
        lead = np.zeros(len(docs), np.uint64)
        by = np.lexsort((term, -tf, text))
        lead[text[by][::-1]] = term[by][::-1]
        place = np.empty(len(docs), np.int64)
        order = np.lexsort((docs, n, lead))
        place[order] = np.arange(len(docs))
        text = place[text]
        by = np.lexsort((text, term))
        term, text, tf = term[by], text[by], tf[by]
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        yield rows_batch([(task + number, len(docs), int(n.sum()), docs[order].tobytes(), n[order].astype(np.int64).tobytes(), pack_sorted(term[start]),
                           pack(np.diff(np.append(start, len(term))).astype(np.uint32)), pack(text.astype(np.uint32)), pack(tf.astype(np.uint32)))], _INDEX)


def _pivot_cut(terms: np.ndarray, fragments: int) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(terms, (np.arange(1, fragments, dtype=np.float64) * (2.0**64 / fragments)).astype(np.uint64)), [len(terms)]))


_FREQ = "frag int, query binary, terms binary, counts binary"


def _shard_terms(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, d in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
                terms, df = unpack_sorted(t), unpack(d, np.uint32)
                at = _pivot_cut(terms, fragments)
                rows = [(f, None, pack_sorted(terms[at[f]:at[f + 1]]), pack(df[at[f]:at[f + 1]])) for f in range(fragments) if at[f + 1] > at[f]]
                if rows:
                    yield rows_batch(rows, _FREQ)

    return run


def _query_terms(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = np.array(batch.column("query_id").to_pylist(), np.int64)
            term, text, tf, _ = _term_counts(text_bytes(batch))
            at = _pivot_cut(term, fragments)
            rows = [(f, ids[text[at[f]:at[f + 1]]].tobytes(), pack_sorted(term[at[f]:at[f + 1]]), pack(tf[at[f]:at[f + 1]].astype(np.uint32))) for f in range(fragments) if at[f + 1] > at[f]]
            if rows:
                yield rows_batch(rows, _FREQ)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Of one fragment of the term space: the queries' terms with their document frequencies."""
    query, terms, counts = (table.column(c).to_pylist() for c in ("query", "terms", "counts"))
    shards, asked = [i for i, q in enumerate(query) if q is None], [i for i, q in enumerate(query) if q is not None]
    out = [np.zeros(0, np.int64)] * 4
    if shards and asked:
        t, c = np.concatenate([unpack_sorted(terms[i]) for i in shards]), np.concatenate([unpack(counts[i], np.uint32) for i in shards])
        known, back = np.unique(t, return_inverse=True)
        df = np.bincount(back, c, len(known)).astype(np.int64)
        q, qt = np.concatenate([np.frombuffer(query[i], np.int64) for i in asked]), np.concatenate([unpack_sorted(terms[i]) for i in asked])
        qtf = np.concatenate([unpack(counts[i], np.uint32) for i in asked]).astype(np.int64)
        at = np.minimum(np.searchsorted(known, qt), len(known) - 1)
        hit = known[at] == qt
        out = [q[hit], qt[hit].view(np.int64), qtf[hit], df[at[hit]]]
    return pa.table(dict(zip(("query_id", "term", "qtf", "df"), map(pa.array, out), strict=True)))


class _Queries:
    """A block of queries, their terms as places in the sorted list of all of them."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]], least: dict[int, float], n_docs: int):
        terms = [np.frombuffer(t, np.int64).view(np.uint64) for _, t, _, _ in rows]
        self.terms, place = np.unique(np.concatenate(terms), return_inverse=True)
        at = np.cumsum([0, *map(len, terms)]).tolist()
        self.each = []
        for (q, _, qtf, df), lo, hi in zip(rows, at[:-1], at[1:], strict=True):
            f, d = np.frombuffer(qtf, np.int64), np.frombuffer(df, np.int64)
            self.each.append((q, place[lo:hi], f * np.log(1 + (n_docs - d + 0.5) / (d + 0.5)), least.get(q, 0.0)))


class _Shard:
    """Unpacked postings in order of (term, document), with the maxima of terms and of their blocks."""

    def __init__(self, row: dict, k1: float, b: float, avg_len: float):
        self.docs, lens = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lens"], np.int64)
        self.terms, self.size = unpack_sorted(row["terms"]), unpack(row["dfs"], np.uint32).astype(np.int64)
        self.doc, tf = unpack(row["post_doc"], np.uint32).astype(np.int64), unpack(row["post_tf"], np.uint32).astype(np.float64)
        if not len(self.terms):
            return
        self.impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[self.doc] / avg_len))
        self.first = np.cumsum(self.size) - self.size
        owner, block = np.repeat(np.arange(len(self.terms)), self.size), self.doc // BLOCK
        self.key = owner * len(self.docs) + self.doc
        # entries: runs of postings of one term in one block
        self.entry = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))))
        self.e_size, self.e_block, self.e_max = np.diff(np.append(self.entry, len(self.doc))), block[self.entry], np.maximum.reduceat(self.impact, self.entry)
        self.e_first = np.searchsorted(owner[self.entry], np.arange(len(self.terms) + 1))
        self.e_count = np.diff(self.e_first)
        self.most = np.maximum.reduceat(self.e_max, self.e_first[:-1])
        self.blocks = int(block.max()) + 1

    def slots(self, asked: np.ndarray) -> np.ndarray:
        """For each asked term its number here, or -1."""
        at = np.minimum(np.searchsorted(asked, self.terms), len(asked) - 1)
        hit = asked[at] == self.terms
        out = np.full(len(asked), -1, np.int64)
        out[at[hit]] = np.flatnonzero(hit)
        return out

    def top(self, terms: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and rounded scores of documents of at least the score `least`."""
        bound = weight * self.most[terms]
        if not len(terms) or bound.sum() < least - _SLACK:
            return _NONE
        order = np.argsort(-self.size[terms] / np.maximum(bound, 1e-300))
        sums = np.cumsum(bound[order])
        m = int(np.searchsorted(sums, least - _SLACK))
        rest, walk, later = float(sums[m - 1]) if m else 0.0, order[m:], order[:m]
        e, w = _ranges(self.e_first[terms[walk]], self.e_count[terms[walk]], weight[walk])
        block = self.e_block[e]
        open_ = np.bincount(block, w * self.e_max[e], self.blocks) + rest >= least - _SLACK
        if not open_.all():
            kept = np.flatnonzero(open_[block])
            e, w = e[kept], w[kept]
        p, w = _ranges(self.entry[e], self.e_size[e], w)
        part = np.bincount(self.doc[p], w * self.impact[p], len(self.docs))
        found = np.flatnonzero((part > 0) & (part + rest >= least - _SLACK))
        score = part[found]
        if m and len(found):
            if 12 * m * len(found) > self.size[terms[later]].sum():
                p, w = _ranges(self.first[terms[later]], self.size[terms[later]], weight[later])
                score = score + np.bincount(self.doc[p], w * self.impact[p], len(self.docs))[found]
            else:
                key = (terms[later][:, None] * len(self.docs) + found).ravel()
                at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                more = np.where(self.key[at] == key, self.impact[at], 0.0).reshape(m, -1)
                score = score + weight[later] @ more
        score = np.round(score, 6)
        good = (score > 0) & (score >= least)
        return found[good], score[good]


_NONE = np.zeros(0, np.int64), np.zeros(0)


def _ranges(first: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from first[i] on, size[i] of them, and weight[i] for each."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0), np.repeat(weight, size)


_FOUND = "query_id long, doc_id long, score double"


def _score(block, k: int, k1: float, b: float, n_docs: int, avg_len: float):
    """The best k of the shards of a partition for each query of a broadcast block, if they can be among all best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Shard(batch.slice(i, 1).to_pylist()[0], k1, b, avg_len)
                if not len(shard.terms):
                    continue
                queries = queries or _Queries(*block.value, n_docs)
                slots = shard.slots(queries.terms)
                for q, places, weight, least in queries.each:
                    own = slots[places]
                    hit = own >= 0
                    held_s, held_d = best.get(q, (_NONE[1], _NONE[0]))
                    least = max(least, float(held_s[-1])) if len(held_s) == k else least
                    found, s = shard.top(own[hit], weight[hit], least)
                    if len(found):
                        s, d = np.concatenate((held_s, s)), np.concatenate((held_d, shard.docs[found]))
                        if len(s) > 4 * k:
                            cut = np.partition(s, len(s) - k)[len(s) - k]
                            s, d = s[s >= cut], d[s >= cut]
                        order = np.lexsort((d, -s))[:k]
                        best[q] = (s[order], d[order])
        if best:
            n = [len(s) for s, _ in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), n)), pa.array(np.concatenate([d for _, d in best.values()])), pa.array(np.concatenate([s for s, _ in best.values()]))], ["query_id", "doc_id", "score"])

    return run


def search(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, rank, doc_id, score: for queries(query_id, text) the k best of docs(doc_id, text)."""
    spark = docs.sparkSession
    fragments = 2 * partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "text").where("query_id is not null")
    index = materialize(docs.mapInArrow(_index, _INDEX), "index")
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("w"), F.count("*").alias("shards")).first()
    n_docs, avg_len = total["n"] or 0, max(1.0, (total["w"] or 0) / (total["n"] or 1))
    freq = index.select("terms", "dfs").mapInArrow(_shard_terms(fragments), _FREQ).unionAll(queries.mapInArrow(_query_terms(fragments), _FREQ))
    terms = freq.groupBy("frag").applyInArrow(_meet, "query_id long, term long, qtf long, df long")
    packed = materialize(terms.groupBy("query_id").applyInArrow(_pack_query, "query_id long, words long, t binary, qtf binary, df binary"), "queries")
    words = packed.agg(F.sum("words")).first()[0] or 0
    blocks = -(-words // QUERY_BLOCK_WORDS) or 1
    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    one_in = lambda n: F.pmod(F.xxhash64("shard"), F.lit(n)) == 0
    few, some = SEED_SHARDS
    parts = [index.where(one_in(few)), index.where(one_in(some) & ~one_in(few)), index.where(~one_in(some))] if total["shards"] >= 2 * some else [index]
    found = None
    for i in range(blocks):
        # a part of the terms bounded by QUERY_BLOCK_WORDS, whatever the number of queries
        rows = [(r["query_id"], bytes(r["t"]), bytes(r["qtf"]), bytes(r["df"])) for r in packed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()]
        if not rows:
            continue
        least: dict[int, float] = {}
        own = None
        for part in parts:
            block = spark.sparkContext.broadcast((rows, least))
            found_here = materialize(part.mapInArrow(_score(block, k, k1, b, n_docs, avg_len), _FOUND), "found")
            own = found_here if own is None else own.unionAll(found_here)
            if part is not parts[-1]:
                least = {r["query_id"]: r["score"] for r in best(own).where(F.col("rank") == k).collect()}
        found = own if found is None else found.unionAll(own)
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    return best(found).select("query_id", "rank", "doc_id", "score")


def _pack_query(table: pa.Table) -> pa.Table:
    """Of one query (its distinct words are as many as its text has at most)."""
    t, qtf, df = (np.asarray(table.column(c), np.int64) for c in ("term", "qtf", "df"))
    return pa.table({"query_id": table.column("query_id").slice(0, 1), "words": pa.array([len(t)], pa.int64()), "t": pa.array([t.tobytes()], pa.binary()), "qtf": pa.array([qtf.tobytes()], pa.binary()), "df": pa.array([df.tobytes()], pa.binary())})
