import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxspark.llm import mixing, quality, queries, url_filter

from .edge import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def _kept(t):
    """All rules, one text at a time; document 2 of the edge rows, upper case throughout, is one that shouts."""
    t = t or ""
    n, chars, symbols, dup, rep = _base(t)
    lines, letters = sum(1 for x in t.split("\n") if WORD.search(x)), sum(1 for w in WORD.findall(t) if re.search(r"[A-Za-z\x80-\U0010ffff]", w))
    return not (n < 10 or 100 * rep > 20 * n or 10 * symbols > n or chars < 3 * n or chars > 12 * n or 100 * letters < 70 * n or 100 * dup > 40 * lines or 100 * len(re.findall("[A-Z]", t)) > 40 * chars)


def _check(rows, texts):
    for r in rows:
        n, chars, symbols, dup, rep = _base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (r.base_failed and r.kept)


def test_op4_query_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _check(queries.op4_quality_rules(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})
    edge = documents(spark)
    rows = quality.quality_scores(edge).collect()
    _check(rows, {r.doc_id: r.text for r in edge.collect()})
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == {r.doc_id for r in edge.collect() if _kept(r.text)}
    assert {1, 3, 4} <= kept and not kept & {5, 6, 7, 8, 10}
    assert {r.doc_id for r in quality.quality_filter(edge).collect()} == kept
    assert quality.quality_filter(edge).columns == edge.columns
    assert quality.quality_scores(edge.limit(0)).count() == 0


def test_cascade_order_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.doc_id for r in quality.quality_filter(docs, quality.RULES).collect()}
    two = {r.doc_id for r in quality.quality_scores(docs, method=quality.METHOD_RULES[::-1]).where("kept").collect()}
    assert one == two
    ordered = quality.plan_cascade(docs)
    assert len(ordered) == len(quality.RULES)
    seen = [r.seen for r in quality.cascade_counts(docs, ordered).orderBy("place").collect()]
    assert seen[0] == docs.count() and seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    # what costs nothing more and rejects something goes first
    assert quality.plan_cascade(docs, quality.METHOD_RULES, held=quality.BASE_GROUPS)[0].name in ("symbols", "word_length", "repeated_lines")


def test_mixing_reaches_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, None).otherwise("small").alias("source"))
    out = mixing.mix_sources(docs, targets={"big": 3.0, "small": 1.0, None: 1.0})
    got = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for s, share in (("big", 0.6), ("small", 0.2), (None, 0.2)):
        assert abs(got[s] - 6000 * share) < 250
    again = mixing.mix_sources(docs.repartition(7), targets={"big": 3.0, "small": 1.0, None: 1.0})
    assert sorted(r.shuffle_key for r in out.collect()) == sorted(r.shuffle_key for r in again.collect())
    copies = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_no").alias("m"))
    assert copies.where("n <> m + 1").isEmpty()


def test_mixing_salted_join_equals_broadcast(spark, monkeypatch):
    docs = documents(spark)
    one = sorted((r.doc_id, r.copy_no) for r in mixing.mix_sources(docs, epochs=3.0).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.copy_no) for r in mixing.mix_sources(docs, epochs=3.0).collect()) == one
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_refuses_absurd_rates(spark):
    with pytest.raises(ValueError):
        mixing.mix_sources(documents(spark), epochs=1e6)


RULE_CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("HTTP://WWW.Example.NET/en/1?a=b#c", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net", "example.net", "", None, None),
    ("https://b.example.com/de/9", "b.example.com", "/de/9", "example.com/de/", "block"),
    ("https://myexample.com/de/9", "myexample.com", "/de/9", None, None),
    ("ftp://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("no scheme", "", "", None, None),
    ("http://h?q=/://", "h", "", None, None),
    (None, "", "", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(RULE_CASES)], "page_id long, url string").withColumn("host", F.lit("clash"))
    empty = url_filter.UrlModel(spark.createDataFrame([], "url string, label double"))
    rows = {r.page_id: r for r in url_filter.judge_urls(df, queries.URL_RULES, empty).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(RULE_CASES):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or "allow")


def test_url_trees_on_held_out_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).select("url").distinct()
    labelled = url_filter.seed_labels(pages).withColumn("held", F.pmod(F.hash("url"), F.lit(4)) == 0)
    model = url_filter.UrlModel(labelled.where("not held").select("url", "label"))
    scored = model.predict(labelled.where("held")).withColumn("ok", F.col("unwanted") == (F.col("label") == 1.0))
    assert scored.agg(F.avg(F.col("ok").cast("int"))).first()[0] > 0.98
    assert scored.where("label = 1").agg(F.avg(F.col("ok").cast("int"))).first()[0] > 0.8


def test_suffix_statistics_count_all_labelled_rows(spark):
    rows = [(f"http://h{i}.s{i % 7}.net/{i}", float(i % 3 == 0)) for i in range(120)] + [("http://h0.s0.net/0", 1.0)] * 4 + [(None, 0.0)]
    model = url_filter.UrlModel(spark.createDataFrame(rows, "url string, label double"), max_train_rows=4)
    got = {r.suffix: (r.suffix_rate, r.suffix_log_n) for r in model.suffixes.collect()}
    expected = {}
    for url, label in rows:
        expected.setdefault(url.split("/")[2].split(".", 1)[1] if url else "", []).append(label)
    assert got == {k: (pytest.approx((sum(v) + 1) / (len(v) + 2)), pytest.approx(math.log(1 + len(v)))) for k, v in expected.items()}
    scored = model.predict(spark.createDataFrame([(r[0],) for r in rows], "url string"))
    assert scored.count() == len(rows)


def test_mixing_null_ids_and_sources(spark):
    rows = [(None, "a", None), *[(i, f"t{i}", None) for i in range(40)], *[(100 + i, "b", "x") for i in range(10)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, targets={None: 1.0, "x": 1.0}).collect()
    assert {r.source for r in got} == {None, "x"}
    copies = [r for r in got if r.doc_id is None]
    assert len({r.copy_no for r in copies}) == len(copies)


def test_op8_query_of_no_pages_and_null_urls(spark, tmp_path):
    def judged(rows, name):
        spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/{name}/pages.parquet")
        return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op8_url_filter(spark, f"{tmp_path}/{name}").collect()}

    assert judged([], "none") == {}
    seeds = [(i, f"http://{'casino' if i % 2 else 'shop'}{i}.com/p/{i}", "") for i in range(60)]
    odd = [(100, None, ""), (101, "no scheme", ""), (102, "HTTP://A.Example.NET/en/x?y", ""), (103, "http://b.example.net/fr/", ""), (104, "ftp://x.org/fr/a#b", ""), (105, "http://example.com/de/", "")]
    got = judged([*seeds, *odd], "some")
    assert got[100][:3] == got[101][:3] == ("", "", None) and got[100][3] in ("allow", "block")
    assert got[102] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[103][2:] == ("net/", "block")
    assert got[104][2:] == ("org/fr/", "allow") and got[105][2:] == ("example.com/de/", "block")
