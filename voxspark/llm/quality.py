"""Quality rules as a short-circuit cascade.

Each rule reads one or two feature groups and rejects rows.  On a bounded sample (rows
spread over the first batch of every partition) the cascade measures what a group costs a
row and which rules reject a row together, and then takes, again and again, the rule that
rejects most of the rows still left for the cost of the groups that no rule before it
has.  A row that one rule rejects is not shown to the rules (and feature groups) after it.
The verdict is the conjunction of all rules, so the order changes the cost only, never
the result.

Words are runs of characters other than space and \\t..\\r.  Rules, all in integers:

====================  ==========================================================
too_few_words         n_words < 10
repeated_windows      100 * n_repeat_words > 20 * n_words
symbols               10 * n_symbols > n_words
word_length           word_chars < 3 * n_words, or > 12 * n_words
no_letters            100 * n_letter_words < 70 * n_words
repeated_lines        100 * n_dup_lines > 40 * n_lines
shouting              100 * n_upper > 40 * word_chars
====================  ==========================================================

Defined results: null text counts as empty and fails too_few_words; an empty table
gives an empty table; extra columns are passed on by quality_filter and are not read
by quality_scores.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import steps, text_bytes
from .hashing import chunks, windows_of, words_of

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODE_POINT = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
_LETTER = _UPPER | ((np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))) | (np.arange(256) >= 0x80)

Features = dict[str, np.ndarray]


def _per_text(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))[np.concatenate(([0], ends))])


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum([len(t) + 1 for t in texts])


def _words(texts: list[bytes]) -> Features:
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars")}
    for lo, hi in chunks(texts):
        data, ends = _joined(texts[lo:hi])
        word = ~_SPACE[data]
        starts = word & ~np.concatenate(([False], word[:-1]))
        out["n_words"][lo:hi] = _per_text(starts, ends)
        out["word_chars"][lo:hi] = _per_text(_CODE_POINT[data], ends)
    return out


def _letters(texts: list[bytes]) -> Features:
    out = np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        data, ends = _joined(texts[lo:hi])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_SPACE[data])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
        with_letter = np.concatenate(([0], np.cumsum(letters[end] > letters[start], dtype=np.int64)))
        out[lo:hi] = np.diff(with_letter[np.concatenate(([0], np.searchsorted(start, ends)))])
    return {"n_letter_words": out}


def _characters(name: str, flag: np.ndarray) -> Callable[[list[bytes]], Features]:
    def count(texts: list[bytes]) -> Features:
        out = np.zeros(len(texts), np.int64)
        for lo, hi in chunks(texts):
            data, ends = _joined(texts[lo:hi])
            out[lo:hi] = _per_text(flag[data], ends)
        return {name: out}

    return count


def _lines(texts: list[bytes]) -> Features:
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n = np.array([len(x) for x in lines], np.int64)
    return {"n_lines": n, "n_dup_lines": n - np.array([len(set(x)) for x in lines], np.int64)}


def _repeats(texts: list[bytes]) -> Features:
    out = np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        words, offset = words_of(texts[lo:hi], lower=False)
        window = windows_of(words, 5)
        for i, (a, b) in enumerate(zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True)):
            own = window[a:max(a, b - 4)]
            s = np.sort(own)
            again = s[1:][s[1:] == s[:-1]]
            if len(again):
                at = np.flatnonzero(np.isin(own, again))
                step = np.zeros(b - a + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + 5, -1)
                out[lo + i] = (np.cumsum(step) > 0).sum()
    return {"n_repeat_words": out}


GROUPS: dict[str, Callable[[list[bytes]], Features]] = {
    "words": _words, "symbols": _characters("n_symbols", _SYMBOL), "lines": _lines, "repeats": _repeats, "letters": _letters, "upper": _characters("n_upper", _UPPER)}
#: The groups of the base counts, which quality_scores has of every row.
BASE_GROUPS = ("words", "symbols", "lines", "repeats")


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which `rejects` holds of the features of `groups`."""

    name: str
    groups: tuple[str, ...]
    rejects: Callable[[Features], np.ndarray]


BASE_RULES = (
    Rule("too_few_words", ("words",), lambda f: f["n_words"] < 10),
    Rule("repeated_windows", ("words", "repeats"), lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
)
METHOD_RULES = (
    Rule("symbols", ("words", "symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("word_length", ("words",), lambda f: (f["word_chars"] < 3 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"])),
    Rule("no_letters", ("words", "letters"), lambda f: 100 * f["n_letter_words"] < 70 * f["n_words"]),
    Rule("repeated_lines", ("lines",), lambda f: 100 * f["n_dup_lines"] > 40 * f["n_lines"]),
    Rule("shouting", ("words", "upper"), lambda f: 100 * f["n_upper"] > 40 * f["word_chars"]),
)
RULES = (*BASE_RULES, *METHOD_RULES)


class _Rows:
    """Features of a batch, each group computed for the asked rows only, once."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.held, self.known = texts, {}, {g: np.zeros(len(texts), bool) for g in GROUPS}

    def features(self, groups: tuple[str, ...], rows: np.ndarray) -> Features:
        out: Features = {}
        for g in groups:
            new = rows[~self.known[g][rows]]
            if len(new) or g not in self.held:
                got = GROUPS[g]([self.texts[i] for i in new.tolist()])
                held = self.held.setdefault(g, {k: np.zeros(len(self.texts), np.int64) for k in got})
                for k, v in got.items():
                    held[k][new] = v
                self.known[g][new] = True
            out |= {k: v[rows] for k, v in self.held[g].items()}
        return out


def _passes(rows: _Rows, rules: tuple[Rule, ...], alive: np.ndarray, seen: list[int] | None = None) -> np.ndarray:
    """Of the rows in alive those that all rules keep; seen gets how many rows each rule was shown."""
    for rule in rules:
        if seen is not None:
            seen.append(len(alive))
        if len(alive):
            alive = alive[~rule.rejects(rows.features(rule.groups, alive))]
    return alive


_SAMPLED = "kind string, what long, rows long, seconds double"


def _measure(rules: tuple[Rule, ...], most: int):
    """Of up to `most` rows of a partition's first batch: rows by the rules that reject them (as bits), and seconds by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            places = np.unique(np.linspace(0, batch.num_rows - 1, min(most, batch.num_rows)).astype(np.int64))
            out = []
            for part in steps([batch.take(pa.array(places))]):
                rows, every = _Rows(text_bytes(part)), np.arange(part.num_rows)
                for i, g in enumerate(GROUPS):
                    began = time.perf_counter()
                    rows.features((g,), every)
                    out.append(("group", i, len(every), time.perf_counter() - began))
                bits = sum((r.rejects(rows.features(r.groups, every)).astype(np.int64) << i for i, r in enumerate(rules)), np.zeros(len(every), np.int64))
                out += [("rules", int(b), int(n), 0.0) for b, n in zip(*np.unique(bits, return_counts=True), strict=True)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["kind", "what", "rows", "seconds"])
            return

    return run


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, held: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The rules, each the one that rejects most of the rows left by those before it for the cost it adds.

    sample_rows are dealt out over the partitions, one row of each at least; held names
    groups that cost nothing, as they are there anyway.
    """
    texts = docs.select("text")
    each = -(-sample_rows // max(1, texts.rdd.getNumPartitions()))
    found = texts.mapInArrow(_measure(rules, each), _SAMPLED).groupBy("kind", "what").agg(F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds")).collect()
    names = list(GROUPS)
    cost = {names[r["what"]]: r["seconds"] / max(1, r["rows"]) for r in found if r["kind"] == "group"}
    alive = {r["what"]: r["rows"] for r in found if r["kind"] == "rules"}
    left, ordered, have = list(enumerate(rules)), [], set(held)
    while left:
        gain = lambda x: sum(n for b, n in alive.items() if b >> x[0] & 1) / (1e-9 + sum(cost.get(g, 0.0) for g in x[1].groups if g not in have))
        best = max(left, key=lambda x: (gain(x), -x[0]))
        left.remove(best)
        ordered.append(best[1])
        have |= set(best[1].groups)
        alive = {b: n for b, n in alive.items() if not b >> best[0] & 1}
    return tuple(ordered)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows (all columns) that every rule keeps."""
    ordered = plan_cascade(docs, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            kept = np.zeros(batch.num_rows, bool)
            kept[_passes(_Rows(text_bytes(batch)), ordered, np.arange(batch.num_rows))] = True
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def cascade_counts(docs: DataFrame, ordered: tuple[Rule, ...]) -> DataFrame:
    """place (from 0), rule, and seen: the rows that the rules before it left for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            seen: list[int] = []
            _passes(_Rows(text_bytes(batch)), ordered, np.arange(batch.num_rows), seen)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ordered)), pa.int64()), pa.array([r.name for r in ordered]), pa.array(seen, pa.int64())], ["place", "rule", "seen"])

    return docs.select("text").mapInArrow(run, "place long, rule string, seen long").groupBy("place", "rule").agg(F.sum("seen").alias("seen"))


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_scores(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, method: tuple[Rule, ...] = METHOD_RULES, sample_rows: int = 2000) -> DataFrame:
    """doc_id, the base counts of every row, base_failed, and the cascade's verdict."""
    ordered = plan_cascade(docs, method, sample_rows, held=BASE_GROUPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = _Rows(text_bytes(batch))
            f = rows.features(BASE_GROUPS, np.arange(batch.num_rows))
            failed = np.any([r.rejects(f) for r in base], axis=0)
            kept = np.zeros(batch.num_rows, bool)
            kept[_passes(rows, ordered, np.flatnonzero(~failed))] = True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(f[c]) for c in _COLUMNS), pa.array(failed), pa.array(kept)], ["doc_id", *_COLUMNS, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", base_failed boolean, kept boolean")
