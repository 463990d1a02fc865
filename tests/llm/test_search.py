import math
import re
from collections import Counter

from pyspark.sql import functions as F

from voxspark.llm import search

from .edge import documents


def brute(queries, docs, k=10, k1=1.2, b=0.75):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tf = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, avg = len(tf), max(1.0, sum(x[2] for x in tf) / max(1, len(tf)))
    df = Counter(w for _, c, _ in tf for w in c)
    out = {}
    for q, t in queries:
        scored = []
        for i, c, dl in tf:
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * dl / avg)) for w, m in Counter(words(t)).items() if w in c)
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def _same(got, expected):
    assert got.keys() == expected.keys()
    for x in got:
        assert got[x][0] == expected[x][0] and abs(got[x][1] - expected[x][1]) < 2e-6


def test_equals_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute([x for x in rows if x[0] % 20 == 0], rows)
    monkeypatch.setattr(search, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(search, "QUERY_BLOCK_WORDS", 500)
    _same({(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.search(q, docs).collect()}, expected)


def test_edges(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    q = docs.select(F.col("doc_id").alias("query_id"), "text")
    _same({(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.search(q, docs, k=3).collect()}, brute(rows, rows, k=3))
    assert search.search(q, docs.limit(0)).count() == 0 and search.search(q.limit(0), docs).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "alpha beta"), (1, "alpha beta gamma"), (1, "gamma"), (2, "beta"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(None, "alpha"), (7, "alpha"), (7, "beta"), (8, None)], "query_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id, r.score) for r in search.search(q, docs).orderBy("query_id", "rank").collect()]
    assert {x[0] for x in got} == {7} and {x[2] for x in got} == {1, 2}
    one = spark.createDataFrame([(7, "alpha beta")], "query_id long, text string")
    assert got == [(r.query_id, r["rank"], r.doc_id, r.score) for r in search.search(one, docs).orderBy("rank").collect()]
