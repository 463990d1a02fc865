"""Example tables of the text rules, and properties."""

import pytest
from pyspark.sql import functions as F

from voxspark.functions import spoken, text
from voxspark.operators import commands, segments

ITN = [
    ("I have twenty three apples", "I have 23 apples"), ("five dollars and fifty cents", "$5.50"), ("two thirty pm", "2:30 PM"), ("the third of may", "May 3"),
    ("a tenth of the budget", "a tenth of the budget"), ("fifty million dollars", "$50,000,000"), ("pi is 3.1415926", "pi is 3.1415926"), ("five and six", "5 six"),
    ("one million two thousand", "1,000,002,000"), ("at the eleventh hour", "at the eleventh hour"), ("the third floor", "the 3rd floor"), ("first of all", "first of all"),
    ("twenty-first", "21st"), ("one of the", "one of the"), ("nine am", "9 AM"), ("a five second break", "a five second break"), ("$50000.25", "$50,000.25"), ("12345", "12345"),
    ("one hundred and five", "105"), ("two thousand twenty four", "2024"), ("", ""), ("  ", "  "),
]


@pytest.mark.parametrize(("said", "written"), ITN)
def test_itn(said, written):
    assert spoken.itn(said) == written
    assert spoken.itn(spoken.itn(said)) == spoken.itn(said)


MARKS = [
    ("hello comma world", "hello, world"), ("stop period go", "stop. Go"), ("period hello", "hello"), ("really question mark yes", "really? Yes"), ("go to google dot com", "go to google.com"),
    ("api dot my site", "api dot my site"), ("twenty hyphen one", "twenty-one"), ("one new line two", "one\nTwo"), ("end. new paragraph start", "end\n\nStart"), ("bob at sign mail dot org", "bob@mail.org"), ("a ampersand b", "a & b"),
]


@pytest.mark.parametrize(("said", "written"), MARKS)
def test_spoken_punctuation(said, written):
    assert spoken.punctuation(said) == written


CLEAN = [
    ("um, we need to to fix this.", "We need to fix this."), ("He had had enough of it.", "He had had enough of it."), ("tr truncated word here.", "Truncated word here."), ("We went home.", "We went home."),
    ("Would you would you like a cappuccino?", "Would you like a cappuccino?"), ("banger after banger after banger", "Banger after banger after banger"), ("w-w-what is it", "W-what is it"), ("so the-the end", "So the end"), ("quéum um, ok", "Quéok"), ("   ", "   "), ("very very good", "Very very good"),
    ("the the end", "The end"), ("wait , what", "Wait, what"),
]


def test_clean(spark):
    df = spark.createDataFrame(CLEAN, "said string, written string").select("written", text.clean_transcript(F.col("said")).alias("got"))
    assert [(r.got, r.written) for r in df.collect()] == [(w, w) for _, w in CLEAN]


JOINS = [
    ([("I went to the store", False), ("And bought some milk", False)], "I went to the store and bought some milk"),
    ([("Would you.", False), ("Would you like a cappuccino?", False)], "Would you like a cappuccino?"),
    ([("we should", True), ("we should go", False)], "we should we should go"),
    ([("It ended.", False), ("And then", False)], "It ended. And then"),
    ([("one", False), ("", False), ("USA", False)], "one USA"),
]


def test_joins(spark):
    rows = [(i, k, t, f) for i, (parts, _) in enumerate(JOINS) for k, (t, f) in enumerate(parts)]
    for n in (1, 5):
        df = spark.createDataFrame(rows, "session_id int, seg_idx int, text string, forced_split boolean").repartition(n)
        assert {r.session_id: r.text for r in segments.join_segments(df).collect()} == {i: t for i, (_, t) in enumerate(JOINS)}


def test_loops(spark):
    looped = "so we go to town " + "and then we all leave " * 4 + "for good"
    df = spark.createDataFrame([(looped,), ("nothing to see here at all, just one long and plain sentence",)], "t string")
    got = df.select(segments.detect_repetition_loop(F.col("t")).alias("d"), segments.collapse_repetition_loop(F.col("t")).alias("c")).collect()
    assert got[0].d and got[0].c == "so we go to town and then we all leave for good" and not got[1].d


def test_fast_path_and_risk(spark):
    cases = [("play jazz on spotify", "play_media"), ("google cats", "search_web"), ("open notepad", "open_target"), ("open a and then b", None), ("hello", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t string").select(commands.match_fast_path(F.col("t"))["tool"].alias("tool"))
    assert [r.tool for r in df.collect()] == [t for _, t in cases]
    goals = [("buy milk", "refuse"), ("reply to bob", "confirm"), ("scroll down", "auto")]
    df = spark.createDataFrame([(g,) for g, _ in goals], "t string").select(commands.assess_goal(F.col("t"))["level"].alias("level"))
    assert [r.level for r in df.collect()] == [x for _, x in goals]


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]


def test_dictionary_follows_chains_to_their_end(spark):
    from pyspark.sql import functions as F

    from voxspark.operators import dictionary

    pairs = [("aa", "bb"), ("bb", "cc"), ("cc", "dd"), ("dd", "ee"), ("zz", "aa")]
    entries = spark.createDataFrame([(str(i), o, r, [], i) for i, (o, r) in enumerate(pairs)], "id string, original string, replacement string, variants array<string>, at long")
    entries = entries.select("id", "original", "replacement", "variants", F.timestamp_seconds("at").alias("created_at"))
    said = spark.createDataFrame([(1, "say aa now"), (2, "cc"), (3, "zz"), (4, None), (5, "none")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dictionary.apply_dictionary(said, entries).collect()}
    assert got == {1: "say ee now", 2: "ee", 3: "aa", 4: None, 5: "none"}  # the last entry comes too late for the first


def test_repetition_loops_of_any_length():
    from voxspark.operators.segments import _collapsed, _runs

    phrase = " ".join(f"word{i}" for i in range(450))
    assert _collapsed(" ".join(["before", *[phrase] * 3, "after"])) == f"before {phrase} after"
    assert _runs("a b c d e".split() * 3) == [(0, 5, 15)] and _runs("x a b c d a b c d a b c d y".split()) == [(1, 4, 13)]


def test_overlap_fold_of_odd_rows(spark):
    rows = [(1, 0, "a b c d"), (1, 1, "B C D e"), (1, 2, None), (1, 3, "  "), (1, 4, "b c d e"), (1, 5, "c d e f"), (2, 0, "c d e f"), (None, 0, "x y z"), (None, 1, "x y z w")]
    got = segments.dedup_overlap(spark.createDataFrame(rows, "session_id long, chunk_idx long, text string")).collect()
    # a chunk that is all overlap leaves an empty text, and the kept words before it stay the ones to compare with
    assert {(r.session_id, r.chunk_idx): r.text for r in got} == {(1, 0): "a b c d", (1, 1): "e", (1, 4): "b c d e", (1, 5): "f", (2, 0): "c d e f", (None, 0): "x y z", (None, 1): "w"}


def test_recipes_that_start_with_a_slot(spark, monkeypatch):
    kinds = "id string, patterns array<string>, slots array<string>, stats struct<quarantined:boolean>"
    recipes = spark.createDataFrame([("r1", ["{a} near {b}"], ["a"], None), ("r2", ["{what}"], ["what"], None), ("r3", ["open {a}"], ["a"], None)], kinds)
    said = spark.createDataFrame([(1, "Bread NEAR  home."), (2, "nearby things"), (3, "open door")], "utterance_id int, text string")
    got = {r.utterance_id: (r.recipe_id, r.slots) for r in commands.match_recipes(said, recipes).collect()}
    assert got == {1: ("r1", {"a": "Bread", "b": "home"}), 2: ("r2", {"what": "nearby things"}), 3: ("r3", {"a": "door"})}
    monkeypatch.setattr(commands, "MAX_OPEN_PATTERNS", 0)
    with pytest.raises(ValueError, match="without a word"):
        commands.match_recipes(said, recipes)


def test_open_recipe_patterns_against_plain_search(spark):
    """Patterns glued to slots, in any case and with odd marks; they are not held in arrays beside each text."""
    import re

    patterns = ["q1{a}", "Q12{a}", "{a}now", "{a}NOW now{b}", "x{a}-y{b}z", "{a}{b}", "{a} {b}", "{a}-{b}", "{a}+ {b}.c", "{x y}{a}", "{a}é", "É{a}", "q1 {a}x{b}", "{a}}", "{a}.*{b}", "(x{a}"]
    texts = ["q12 go", "Q1x", "right now", "NOW", "x1-Y2Z", "a-b", "one", "a+  b.c", "{x y}t", "né", "nÉ", "ét", "Ét", "q1  yxz", "a}", "a.*b", "(Xa", "now\u0085", "right now\u0085", "", None, "a b c"]
    kinds = "id string, patterns array<string>, slots array<string>, stats struct<quarantined:boolean>"
    recipes = spark.createDataFrame([(p, [p], [], None) for p in patterns], kinds).coalesce(1)
    said = spark.createDataFrame(list(enumerate(texts)), "utterance_id int, text string")

    def best(t):
        if t is None:
            return None
        t = re.sub(r"[.!?,]+$", "", re.sub(r"\s+", " ", t.replace("\u0085", "\x00"))).strip().replace("\x00", "\u0085")
        fits = []
        for k, p in enumerate(patterns):
            parts = [r"\s+".join(re.escape(w) for w in re.split(r"\s+", x)) for x in re.split(r"\{\w+\}", p, flags=re.A)]
            if re.search("^" + "([^\u0085\n]+?)".join(parts) + "\u0085?$", t, re.I | re.A):
                fits.append((-len(re.sub(r"\{\w+\}", "", p, flags=re.A)), k))
        return patterns[min(fits)[1]] if fits else None

    for few in (commands.OPEN_BROADCAST, 0):
        m = pytest.MonkeyPatch()
        m.setattr(commands, "OPEN_BROADCAST", few)
        matched = commands.match_recipes(said, recipes)
        got = {r.utterance_id: r.recipe_id for r in matched.collect()}
        m.undo()
        assert got == {i: best(t) for i, t in enumerate(texts) if best(t)}
    assert "collect_list" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_a_first_letter_stays_one_letter(spark):
    said = ["ßheit am ", " ﬁn", "ŉ a", "ᾳ", "ᾼ", "ēs", "", " ", None, "1 ß"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", text.finalize_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == ["ẞheit am", "ﬁn", "ŉ a", "ᾼ", "ᾼ", "Ēs", "", "", None, "1 ß"]
