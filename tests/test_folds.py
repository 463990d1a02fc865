"""Streaming folds against whole sessions, stateful processors on a state of their own, and index joins against plain search."""

import random
import re

import numpy as np
import pandas as pd

from voxspark.operators import audio, commands, segments, vocab
from voxspark.streaming import processors


def whole_join(parts):
    """Every seam on the whole text so far."""
    kept = [(t.strip(), f) for t, f in parts if t and t.strip()]
    text, repairs, trims = (kept[0][0] if kept else ""), 0, 0
    for (_, forced), (right, _) in zip(kept, kept[1:]):
        text, right, t, r = segments.repair_seam(text, right, forced)
        trims, repairs = trims + t, repairs + r
        text += " " + right if right else ""
    return re.sub(r"\s+", " ", text).strip(), repairs, trims


def random_parts(rng, n):
    words = ["the", "And", "store", "we", "should", "But", "go.", "To", "no", "x" * 900, "It’s", "it's", "US", "done."]
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.random() < 0.3) for _ in range(n)]


def test_seam_fold_equals_the_whole_text():
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 400):
        parts = random_parts(rng, n)
        fold, done = segments.SeamFold(), []
        for part in parts:
            done += fold.push(*part)
        assert ("".join([*done, fold.tail]).strip(), fold.repairs, fold.trims) == whole_join(parts)


def test_last_words_of_long_texts():
    text = "a " * 5000 + " ".join("w" * 300 + str(i) for i in range(6))
    assert segments.last_words(text) == ["w" * 300 + str(i) for i in range(6)] and segments.last_words("") == []


def test_token_fold_equals_the_whole_session():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(5, 200))
        tokens = rng.integers(0, 30, n)
        windows = [np.stack((tokens[a:a + 25], (np.arange(a, min(n, a + 25)) * 5 + rng.integers(0, 2)), np.ones(min(25, n - a), int)), axis=1) for a in range(0, n, 20)]
        for w in windows[1:]:
            w[rng.integers(0, len(w)), 0] += 100
        merged = np.zeros((0, 3), np.int64)
        for w in windows:
            merged = segments._merge_pair(merged, w, 2.0)
        fold = segments.TokenFold(2.0)
        got = np.concatenate([*(fold.push(w) for w in windows), fold.finish()])
        assert np.array_equal(got, segments._by_time(merged)) and len(fold.held) <= 80


def test_a_last_window_of_one_token_loses_none():
    """It begins a frame before the end of the one before it: the middle of the two is a token's own time."""
    for k in range(2, 400):
        at = np.arange(20 * (k - 1), 20 * k + 1)
        left = np.stack((at, at * 5 + 1, np.ones_like(at)), axis=1)
        merged = segments._merge_pair(left, np.array([[20 * k, 100 * k, 1]]), 2.0)
        assert merged[:, 0].tolist() == at.tolist(), k


class State:
    """A value, list or map in memory; sizes are what the store would hold."""

    def __init__(self):
        self.v = None

    exists = lambda self: bool(self.v)
    get = lambda self: self.v
    update = lambda self, v: setattr(self, "v", v)
    clear = lambda self: setattr(self, "v", None)
    appendList = lambda self, x: setattr(self, "v", (self.v or []) + list(x))
    getValue = lambda self, k: (self.v or {}).get(k)
    updateValue = lambda self, k, v: setattr(self, "v", (self.v or {}) | {k: v})
    removeKey = lambda self, k: self.v.pop(k)
    iterator = lambda self: iter((self.v or {}).items())


class Entries(State):
    get = lambda self: iter(self.v or [])


class Handle:
    def __init__(self):
        self.states, self.timers, self.watermark = {}, set(), 0
        self.getValueState = self.getMapState = lambda name, *_: self.states.setdefault(name, State())
        self.getListState = lambda name, *_: self.states.setdefault(name, Entries())
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard

    getCurrentWatermarkInMs = lambda self: self.watermark


class Expired:
    def __init__(self, at):
        self.getExpiryTimeInMs = lambda: at


def pushed(processor, handle, frame):
    return [tuple(r)[1:] for df in processor.handleInputRows((7,), iter([frame]), handle) for r in df.itertuples(index=False)]


def chunk_frame(items):
    """(number, level of a second of audio or a word)"""
    rows = [(i, 1000, None if isinstance(x, str) else np.full(1000, x, np.float32), x == "stop", x == "abort", x == "back", pd.Timestamp(1_000_000 + i, unit="s")) for i, x in items]
    return pd.DataFrame(rows, columns=["chunk_idx", "sample_rate", "samples", "stop", "abort", "decoded", "ts"])


def started(idle_ms=None, preview_ms=None):
    p, h = processors.SegmentProcessor(idle_ms, preview_ms), Handle()
    p.init(h)
    return p, h


def test_segments_in_any_order_and_bounded_state():
    rng = random.Random(3)
    levels = [rng.choice([0.15, 0.15, 0.0005]) for _ in range(150)] + [0.15] * 40
    want, s = [], audio.Segmenter(1000)
    for x in levels:
        want += s.push(np.full(1000, x, np.float32))
    want += s.finish()
    order = sorted(range(len(levels)), key=lambda i: i + rng.randint(0, 6))
    p, h = started()
    got = []
    for a in range(0, len(order), 7):
        got += pushed(p, h, chunk_frame([(i, levels[i]) for i in order[a:a + 7]]))
        assert len(h.states["windows"].v or []) <= 28_000 // 32 + 32
    got += pushed(p, h, chunk_frame([(len(levels), "stop")]))
    assert [g[1:] for g in got if g[0] == "segment"] == want and got[-1][0] == "stop"
    assert pushed(p, h, chunk_frame([(len(levels) + 1, 0.15)])) == []  # a row of a session that has ended


def test_abort_idle_and_gaps():
    p, h = started()
    assert pushed(p, h, chunk_frame([(0, 0.15), (1, 0.0005), (2, 0.15)])) == [("segment", 0, 0, 2000, False)]
    assert pushed(p, h, chunk_frame([(3, "abort")])) == [] and not h.states["windows"].v
    p, h = started(idle_ms=5000)
    assert pushed(p, h, chunk_frame([(0, 0.15), (1, 0.15), (3, 0.15)])) == []  # 2 is missing, 3 waits
    (at,) = h.timers
    assert at == 1_000_003_000 + 5000
    stale = [r for df in p.handleExpiredTimer((7,), h, Expired(at - 1)) for r in df.itertuples()]
    got = [tuple(r)[1:5] for df in p.handleExpiredTimer((7,), h, Expired(at)) for r in df.itertuples(index=False)]
    assert stale == [] and got[0] == ("segment", 0, 0, 3000) and got[1][0] == "idle"
    assert not any(s.v for s in h.states.values())


def test_no_preview_while_a_decode_is_out():
    p, h = started(preview_ms=1200)
    got = pushed(p, h, chunk_frame([(0, 0.15), (1, 0.15), (2, 0.15), (3, 0.15), (4, "back"), (5, 0.15), (6, 0.15), (7, 0.0005)]))
    assert got == [("preview", 0, 0, 2000, False), ("preview", 0, 0, 5000, False), ("segment", 0, 0, 7000, False)]


def test_partials_hold_the_end_only():
    parts = random_parts(random.Random(4), 1500)
    p, h = processors.PartialProcessor(None), Handle()
    p.init(h)
    settled = []
    for a in range(0, len(parts), 10):
        frame = pd.DataFrame([(i, *parts[i]) for i in reversed(range(a, min(a + 10, len(parts))))], columns=["seg_idx", "text", "forced_split"])
        for df in p.handleInputRows((7,), iter([frame]), h):
            settled.append(df["settled"][0])
        assert len(h.states["fold"].v[0]) < 20_000 and not h.states["early"].v
    assert ("".join(settled) + df["tail"][0]).strip() == whole_join(parts)[0]


def test_app_names_against_plain_search(spark):
    rng = random.Random(5)
    name = lambda n: "".join(rng.choice("ab C-1") for _ in range(n))
    names = sorted({name(rng.randint(0, 9)) for _ in range(120)})
    asked = [name(rng.randint(0, 5)) for _ in range(80)] + ["task manager", "", "zz"]
    solid = lambda x: re.sub("[^a-z0-9]", "", x.lower())

    def best(q):
        if q in commands.ALIASES:
            return commands.ALIASES[q], "alias"
        hits = [(0 if solid(n) == solid(q) else 1 if solid(n).startswith(solid(q)) else 2, len(n), n) for n in names if solid(q) and solid(q) in solid(n)]
        return (None, None) if not hits else (min(hits)[2], ("exact", "prefix", "contains")[min(hits)[0]])

    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {r["query_id"]: (r["match"], r["tier"]) for r in commands.match_app_names(q, spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {i: best(x) for i, x in enumerate(asked)}


def test_term_ids_against_a_greedy_walk(spark):
    rng = random.Random(6)
    pieces = {x: i for i, x in enumerate(sorted({rng.choice(["▁", ""]) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)}))}
    terms = [None, "", "  ", "ž", *(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 3))) for _ in range(150))]

    def walk(t):
        ids = []
        for w in (t or "").split():
            rest = "▁" + w
            while rest:
                n = next((n for n in range(len(rest), 0, -1) if rest[:n] in pieces), 0)
                if not n:
                    return None
                ids.append(pieces[rest[:n]])
                rest = rest[n:]
        return ids or None

    df = spark.createDataFrame(list(enumerate(terms)), "k long, term string")
    v = spark.createDataFrame(list(pieces.items()), "piece string, id int")
    assert {r["k"]: r["ids"] for r in vocab.tokenize_terms(df, v).collect()} == {i: walk(t) for i, t in enumerate(terms)}


def test_rms_windows_of_odd_chunks(spark):
    rng = np.random.default_rng(7)
    sizes = [0, 1, 5, 47, 48, 49, 200, 3, None, 96]
    waves = [None if n is None else rng.standard_normal(n).astype(np.float32) for n in sizes]
    df = spark.createDataFrame([(1, i, None if w is None else w.tolist()) for i, w in enumerate(waves)], "session_id long, chunk_idx long, samples array<float>")
    whole = np.concatenate([w for w in waves if w is not None]).astype(np.float64)
    want = np.sqrt((whole[:len(whole) // 48 * 48].reshape(-1, 48) ** 2).mean(1))
    got = [r["rms"] for r in audio.rms_windows(df, 48).orderBy("win_idx").collect()]
    assert np.allclose(got, want)


def test_state_of_a_group_comes_back_as_it_was():
    """All states of a group are one row, so a group asks the store once however many entries it has."""

    class Group:
        exists, hasTimedOut, value = False, False, None
        get = property(lambda self: self.value)

        def update(self, v):
            self.exists, self.value = True, v

        def remove(self):
            self.exists, self.value = False, None

    parts = random_parts(random.Random(5), 300)
    run, group, settled = processors.group_handler(processors.PartialProcessor(None), ["fold", "early"]), Group(), []
    order = sorted(range(len(parts)), key=lambda i: i + random.Random(i).randint(0, 9))
    for a in range(0, len(order), 10):
        frame = pd.DataFrame([(i, *parts[i]) for i in order[a:a + 10]], columns=["seg_idx", "text", "forced_split"])
        for df in run((7,), iter([frame]), group):
            settled.append(df["settled"][0])
    assert ("".join(settled) + df["tail"][0]).strip() == whole_join(parts)[0] and group.value[1] is None


def test_longest_run_and_common_pairs_against_plain_search():
    rng = np.random.default_rng(6)
    for _ in range(200):
        match = rng.random((int(rng.integers(2, 9)), int(rng.integers(2, 9)))) < 0.4
        runs = [(-n, i, j) for i in range(match.shape[0]) for j in range(match.shape[1]) for n in range(1, 9) if i + n <= match.shape[0] and j + n <= match.shape[1] and all(match[i + k, j + k] for k in range(n))]
        n, i, j = min(runs, default=(0, 0, 0))
        assert segments._longest_run(match) == [(i + k, j + k) for k in range(-n)]
        common = segments._common(match)
        assert all(match[p] for p in common) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(common, common[1:]))


def test_token_windows_of_odd_sessions(spark):
    """Null and text keys."""
    rows = [(s, w, p, 20 * w + p, (20 * w + p) * 5, 1) for s in (None, "a", "b") for w in range(8) for p in range(25)]
    df = spark.createDataFrame(rows, "session_id string, chunk_idx int, pos int, token long, timestamp long, duration long")
    got = segments.merge_token_chunks(df).collect()
    assert {s: [r.token for r in sorted((r for r in got if r.session_id == s), key=lambda r: r.pos)] for s in (None, "a", "b")} == {s: list(range(165)) for s in (None, "a", "b")}
