"""Spelling variants against a plain search through all single edits."""

import re
import zlib
from collections import Counter

import pytest

from voxspark.llm.queries import op12_spelling_variants
from voxspark.llm.spelling import corpus_words, near_pairs, single_edits, spelling_forms


def words_of(docs, drop=199):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def near_of(words):
    """Near words by the words' own deletions, one place each."""
    gaps = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)
    out = {w: set() for w in words}
    for (_, rest), same in gaps.items():
        for w in same:
            out[w] |= same - {w}
            if rest in words:
                out[w].add(rest)
                out[rest].add(w)
    return out


def expected(words):
    near, forms = near_of(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_op12_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(words_of(docs))
    assert as_dict(op12_spelling_variants(spark, sf)) == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("block", [3, 1024])
def test_odd_words_in_blocks_of_any_size(spark, block):
    chain = [("abcdefg", 5), ("abcdefgh", 30), ("abcdexgh", 200), ("abcdexg", 1200), ("bbcdexg", 7000), ("bbbdexg", 7000), ("bbbdexh", 7000)]
    words = dict(chain) | {f"common{a}{b}" + "x" * 3: 5 + (a + b) % 40 for a in range(9) for b in range(9)} | {"éàéàéà": 9, "éàéàé": 60, "日本語日本語": 5, "日本語日本語語": 500, "aaaaaa": 5, "aaaaaaa": 25, "z" * 300: 5, "z" * 301: 25}
    df = spark.createDataFrame(list(words.items()), "word string, n long").selectExpr("*", "'clash' AS g", "'clash' AS near", "1 AS m")
    assert as_dict(spelling_forms(df, 5, block)) == expected(words)
    assert near_pairs(df, block).count() == sum(len(x) for x in near_of(words).values())
    assert spelling_forms(df.where("false")).count() == 0


def test_odd_texts(spark):
    docs = [(1, "Éclairs éclairs ÉCLAIRS, naïveté_naïveté ×÷×÷×÷ x" + "longword " * 9), (None, "longword nolongword\nlongwords " * 50), (3, None), (4, ""), (5, "ab" * 600_000 + " " + "spelling " * 300_000), (5, "spelling"), *[(i, "variant colour") for i in range(3000)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS word", "'clash' AS n")
    assert {r["word"]: r["n"] for r in corpus_words(df, drop=199).collect()} == words_of(docs)
    assert corpus_words(df.where("doc_id = 3")).count() == 0


def test_a_tile_finds_each_kind_of_edit():
    a, b = ["prefixed", "prefixes"], ["prefixeds", "prefixxes", "preffixed", "prefizzes"]
    at, to = single_edits(a, b, 3, True)
    assert sorted((a[i], b[j]) for i, j in zip(at, to, strict=True)) == [("prefixed", "preffixed"), ("prefixed", "prefixeds"), ("prefixes", "prefixeds"), ("prefixes", "prefixxes")]
