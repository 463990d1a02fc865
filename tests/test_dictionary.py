"""Dictionaries of any size against entry-by-entry replacement of the whole text."""

import pickle
import random
import re
from datetime import datetime, timedelta

import pytest

from voxspark.functions.automaton import WordAutomaton, gaps_of, words_of
from voxspark.operators import dictionary as d


def plain(text, entries):
    for replacement, patterns in entries:
        for p in patterns:
            text = re.sub(rf"\b{re.escape(p)}\b", lambda _: replacement, text, flags=re.I | re.A)
    return text


def random_entries(rng, n):
    parts = ["a", "b", "ab", "B", "a b", "b-a", "c", "c++", "é", "a é", "-", "b a b", "x", "x-1", "&", "a & b", "ca", " b", "_"]
    return [(rng.choice([*parts, "y", "z z", "1", "-q"]), rng.sample(parts, rng.randint(1, 3))) for _ in range(n)]


def random_text(rng):
    return "".join(rng.choice(["a", "b", "ab", "c", "x", "1", " ", " ", "-", "++", "&", " & ", "é", "É", "B", "_", "y"]) for _ in range(rng.randint(0, 25)))


def test_automaton_finds_what_a_search_of_each_pattern_finds():
    rng = random.Random(2)
    patterns = [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["&", " - "]
    automaton = pickle.loads(pickle.dumps(WordAutomaton(patterns)))
    for _ in range(500):
        text = "".join(rng.choice(["a ", "b ", "c ", "d ", "A-", "b&", "c - "]) for _ in range(rng.randint(0, 12)))
        words = words_of(text)
        want = {k for k, p in enumerate(patterns) if (n := len(words_of(p))) and any(words[i:i + n] == words_of(p) for i in range(len(words))) or not n and p in gaps_of(text)}
        assert set(automaton.found(text)) == want


def test_corrections_equal_entry_by_entry():
    rng = random.Random(5)
    for _ in range(600):
        entries = random_entries(rng, rng.randint(1, 12))
        corrections = pickle.loads(pickle.dumps(d.Corrections(entries)))
        for _ in range(8):
            text = random_text(rng)
            assert corrections.apply(text) == plain(text, entries), (text, entries)


@pytest.mark.parametrize("chars", [0, d.AUTOMATON_CHARS])
def test_both_ways_equal_entry_by_entry(spark, chars):
    """As an automaton, and by joins; with chains of entries, nulls, odd ends, clashing columns."""
    rng, start = random.Random(11), datetime(2024, 1, 1)
    entries = random_entries(rng, 25) + [("step 1", ["start"]), ("step 2", ["step 1"]), ("step 3", ["STEP 2"]), ("done", ["step 3", "step"])]
    rows = [(f"{k:02d}", ps[0], r, ps[1:], start + timedelta(seconds=k)) for k, (r, ps) in enumerate(entries)]
    rows += [("98", "never", " ", [], start), ("00", "first", "ONE", None, None), ("97", " ", "X", [], start)]
    texts = [(k, random_text(rng)) for k in range(60)] + [(100, None), (101, ""), (102, "start, Start first step."), (102, "start"), (103, "step 1 " * 3000)]
    dic = spark.createDataFrame(rows, "id string, original string, replacement string, variants array<string>, created_at timestamp")
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'clash' AS t", "'clash' AS key", "'clash' AS found", "'clash' AS w")
    out = d.apply_dictionary(df, dic, automaton_chars=chars)
    assert out.columns == df.columns
    want = [(k, None if t is None else plain(t, [("ONE", ["first"]), *entries])) for k, t in texts]
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted((k, t or "") for k, t in want)
    assert d.apply_dictionary(df, dic.where("false"), automaton_chars=chars).count() == len(texts)
    assert d.apply_dictionary(df.where("false"), dic, automaton_chars=chars).count() == 0


def test_a_row_meets_few_entries():
    names = [f"part {k % 64}" for k in range(2000)]
    corrections = d.Corrections([(f"X-{k}", [n, n.upper(), n.replace(" ", "-")]) for k, n in enumerate(names)])
    assert corrections.due("ship part 7 today", -1) == [7] and corrections.due("ship part 700 today", -1) == []
    assert corrections.apply("ship part 7 today") == "ship X-7 today"


def test_many_entries_of_one_pattern(spark):
    """Without ids and times entries keep the order of their rows; a replacement that opens the way leads to the next of them."""
    chain = [(None, "a", "b", ["A-1"]), (None, "b", "c d", []), (None, "c", "a", []), (None, "a", "e", ["a"]), (None, "a", "f", [])]
    same = [(None, "long term", f"T{i}", ["LONG-TERM", "longterm"]) for i in range(300)]
    entries = spark.createDataFrame([(*x, None) for x in chain + same], "id string, original string, replacement string, variants array<string>, created_at timestamp").coalesce(1)
    said = ["a", "a-1 long term", "b", "c", "Long-Term and longterm", "term long", None, "a", "", "xa b"]
    texts = spark.createDataFrame(list(enumerate(said)), "i int, text string")
    want = [None if t is None else plain(t, [(r, [o, *v]) for _, o, r, v in chain + same]) for t in said]
    for chars in (10**9, 0):
        got = d.apply_dictionary(texts, entries, automaton_chars=chars).collect()
        assert [r.text for r in sorted(got)] == want, chars


def test_a_pattern_of_many_entries_is_joined_once(spark, monkeypatch):
    """Rows that the joins give do not grow with the number of a pattern's entries."""
    plans = []
    written = d._written
    monkeypatch.setattr(d, "_written", lambda df, name: plans.append((name, df.count())) or written(df, name))
    entries = spark.range(400).selectExpr("cast(id as string) id", "'the term' original", "concat('T', id) replacement", "array('term x') variants", "cast(null as timestamp) created_at")
    out = d.apply_dictionary(spark.range(50).selectExpr("'say the term' text"), entries, automaton_chars=0)
    assert {r.text for r in out.collect()} == {"say T0"} and out.count() == 50
    assert dict(plans)["dictionary-patterns"] == 2 and dict(plans)["dictionary-texts"] == 1
