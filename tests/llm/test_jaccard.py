import re

from voxspark.llm import jaccard_join, queries

from .edge import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, sf).collect()}
    assert got == brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_edges(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def test_chains_need_the_undecided_pairs(spark):
    """Texts that slide word by word: neighbours link, a bucket's centre doesn't see them all."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - i, " ".join(words[2 * i:2 * i + 60]), "en", "s") for i in range(60)]
    docs = documents(spark, rows)
    expected = brute([(r[0], r[1]) for r in rows])
    for rounds in (0, 1, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs, star_rounds=rounds).collect()}
        assert got == expected
