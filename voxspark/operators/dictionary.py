"""Personal dictionary: corrections in transcripts, and upkeep of the entries."""

from __future__ import annotations

import functools
import heapq
import re
from bisect import bisect_right
from collections.abc import Sequence
from datetime import datetime
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automaton import WordAutomaton
from ..functions.text import generate_variants
from ..sources.files import work_path

#: Code points of the patterns of a dictionary that goes to the workers as one automaton; larger ones are joined.
AUTOMATON_CHARS = 20_000_000
_FEW = 64
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
#: A term that begins and ends with a word.
_WHOLE = r"[A-Za-z0-9_](?:[\s\S]*[A-Za-z0-9_])?"
Entry = tuple[str, Sequence[str]]  # replacement, patterns


class Corrections:
    """Entries in order, applied to one text at a time.

    A text meets the entries whose whole pattern can stand in it, one for each pattern: the first
    one whose turn is still to come, since that one leaves no place for those behind it.  A replacement can bring a
    pattern about only by its words, or by an end that isn't a word's; then the text is searched again for
    later entries.
    """

    def __init__(self, entries: Sequence[Entry]) -> None:
        self.entries = [(r, [p for p in ps if p and p.strip()]) for r, ps in entries]
        owners: dict[str, list[int]] = {}
        for e, (r, patterns) in enumerate(self.entries):
            for p in dict.fromkeys(p.translate(_LOWER) for p in patterns):
                owners.setdefault(p, []).append(e)
        self.automaton, self.owners = WordAutomaton(owners), list(owners.values())
        self.opens = [opens(r, ps) or self.automaton.knows(r) for r, ps in self.entries]

    def due(self, text: str, after: int) -> list[int]:
        """A heap of the entries behind `after` that the text meets."""
        own = (self.owners[k] for k in set(self.automaton.found(text)))
        heap = list({e[k] for e in own if (k := bisect_right(e, after)) < len(e)})
        heapq.heapify(heap)
        return heap

    def apply(self, text: str) -> str:
        heap = self.due(text, -1)
        while heap:
            e = heapq.heappop(heap)
            text, hits = replaced(text, *self.entries[e])
            if hits and self.opens[e]:  # even where it puts in what was there
                heap = self.due(text, e)
        return text


def opens(replacement: str, patterns: Sequence[str]) -> bool:
    """Whether words can join or meet where the replacement is put in."""
    return any(not re.fullmatch(_WHOLE, x) for x in (replacement, *patterns))


@functools.lru_cache(20_000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(pattern)}\b", re.I | re.A)


def replaced(text: str, replacement: str, patterns: Sequence[str]) -> tuple[str, int]:
    """The text after one entry, and the number of places."""
    hits = 0
    for p in patterns:
        text, n = _compiled(p).subn(lambda _: replacement, text)
        hits += n
    return text, hits


def dictionary_udf(entries: Sequence[tuple[str, str, Sequence[str]]]):
    """A Column function that applies (original, replacement, variants) in entry order.

    For dictionaries that go along with the function; see apply_dictionary for those of any size.
    """
    kept = [(r, [p for p in [o, *(vs or [])] if p and p.strip()]) for o, r, vs in entries if r and r.strip()]
    corrections = None if sum(len(ps) for _, ps in kept) <= _FEW else Corrections(kept)
    few = [(p.lower(), p, r) for r, ps in kept for p in ps]

    def one(t: str) -> str:
        """Of a few terms each is looked for by itself."""
        low = t.lower()
        for p, pattern, r in few:
            if p in low:
                t, hits = replaced(t, r, [pattern])
                low = t.lower() if hits else low
        return t

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(corrections.apply if corrections else one, na_action="ignore")

    return lambda c: run(c)


def _written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the session's shared folder: its lineage ends here."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_dictionary(df: DataFrame, dictionary: DataFrame, text: str = "text", automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Corrections from a dictionary of any size (id, original, replacement, variants, created_at), by creation, then id.

    Up to automaton_chars of patterns, the entries go to the workers as an automaton, and no
    row moves.  Beyond that, distinct texts and patterns meet in an equi-join on all words of the pattern in a row.  Either way a
    row gets those entries only whose whole pattern can stand in it, and both give the same texts.
    """
    terms = dictionary.where(F.trim("replacement") != "").select("created_at", "id", "replacement", F.filter(F.concat(F.array("original"), F.coalesce("variants", F.array().cast("array<string>"))), lambda p: F.trim(p) != "").alias("patterns"))
    size = terms.select(F.sum(F.length("replacement") + F.aggregate("patterns", F.lit(0).cast("long"), lambda n, p: n + F.length(p) + 8))).first()[0] or 0
    if size > automaton_chars:
        return _apply_joined(df, terms, text)
    entries = sorted(((r["created_at"] is not None, r["created_at"], r["id"] is not None, r["id"], r["replacement"], r["patterns"]) for r in terms.collect()), key=lambda r: (r[0], r[1] or datetime.min, r[2], r[3] or ""))
    held = df.sparkSession.sparkContext.broadcast(Corrections([(r[4], r[5]) for r in entries]))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(held.value.apply, na_action="ignore")

    return df.withColumn(text, run(F.col(text)))


def _pieces(c: str) -> Column:
    """The words of a text, in lower case."""
    return F.transform(F.regexp_extract_all(F.col(c), F.lit(r"([A-Za-z0-9_]+)"), 1), F.lower)


def _gaps(c: str) -> Column:
    """What stands between one word and the next, each behind a line break."""
    s = F.split(c, "[A-Za-z0-9_]+")
    return F.transform(F.slice(s, 2, F.greatest(F.size(s) - 2, F.lit(0))), lambda g: F.concat(F.lit("\n"), g))


def _gram(n: int):
    return lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))


#: Changed texts up to so many are broadcast to their rows.
_FEW_TEXTS = 100_000


def _apply_joined(df: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """Rounds of joins over distinct texts: each applies what a text meets up to the first entry that may open the way for a later one.

    A pattern of many entries stands in the join once, with the first of them, and in later rounds with the next one
    behind the entry that was applied last.  Keys are hashes: a wrong one leads to a pattern that isn't found.
    """
    # entries alike in time and id keep the order of their rows, as in the automaton
    order = F.struct(F.col("created_at").isNotNull().alias("dated"), "created_at", "id", F.monotonically_increasing_id().alias("n"))
    terms = _written(terms.select(order.alias("order"), "replacement", "patterns"), "dictionary-terms")
    lower = F.array_distinct(F.transform("patterns", lambda p: F.translate(p, ascii_uppercase, ascii_lowercase)))
    long = terms.select("order", F.posexplode(lower).alias("pos", "pattern"))
    first = long.groupBy("pattern").agg(F.min(F.struct("order", "pos")).alias("o")).select("pattern", "o.order", "o.pos", _pieces("pattern").alias("words"))
    first = _written(first.withColumn("word_key", F.when(F.size("words") > 0, F.array_join("words", " ")).otherwise(F.concat(F.lit("\n"), "pattern"))), "dictionary-patterns")
    known = first.select(F.explode(F.when(F.size("words") > 0, F.col("words")).otherwise(F.array("word_key"))).alias("w")).distinct()
    put_in = terms.select("order", F.explode(F.concat(_pieces("replacement"), _gaps("replacement"))).alias("w")).join(known, "w").select("order").distinct().withColumn("again", F.lit(True))
    whole = rf"\A{_WHOLE}\z"
    opens = ~F.col("replacement").rlike(whole) | F.exists("patterns", lambda p: ~p.rlike(whole)) | F.coalesce("again", F.lit(False))
    entries = terms.join(put_in, "order", "left").select("order", "replacement", opens.alias("opens"), "patterns")
    # where no pattern can come about, those that stand in the text are enough
    entries = _written(entries.withColumn("patterns", F.when(F.col("opens"), F.col("patterns"))), "dictionary-entries")
    lengths = [r[0] for r in first.select(F.size("words")).distinct().collect() if r[0] > 0]  # of patterns, in words: a few numbers
    kind = entries.schema["order"].dataType.simpleString()
    first = first.select(F.xxhash64("word_key").alias("key"), "pattern", "order", "pos")

    @F.pandas_udf(f"text string, done {kind}")
    def run(t: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for x, es in zip(t, found, strict=True):
            done = last = None
            for e in () if es is None else es:
                if e["opens"] and e["order"] == last:  # by another of its patterns
                    continue
                last = e["order"]
                x, hits = replaced(x, e["replacement"], e["patterns"] if e["opens"] else [e["pattern"]])
                if hits and e["opens"]:
                    done = e["order"]
                    break
            out.append((x, done))
        return pd.DataFrame(out, columns=["text", "done"])

    rows = _written(df, "dictionary-rows")
    texts = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("said")).distinct()
    texts = _written(texts.select("said", F.monotonically_increasing_id().alias("_row")), "dictionary-texts")
    todo, final = texts.select("_row", F.col("said").alias("t"), F.lit(None).cast(kind).alias("done")), None
    while True:
        words = todo.select("_row", "done", _pieces("t").alias("w"), _gaps("t").alias("g"))
        grams = [F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), _gram(n))) for n in lengths]
        none = F.array().cast("array<bigint>")
        keys = F.array_distinct(F.concat(F.transform("g", lambda g: F.xxhash64(g)), *[F.coalesce(g, none) for g in grams]))
        met = words.select("_row", "done", F.explode(keys).alias("key")).join(first, "key").select("_row", "done", "pattern", "order", "pos")
        if final is not None:
            met = met.drop("order", "pos").join(_next_owners(met, long), ["pattern", "done"])
        each = met.select("_row", "pattern", "order", "pos").join(entries, "order")
        lists = each.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("order", "pos", "pattern", "replacement", "opens", "patterns"))).alias("found"))
        step = _written(todo.join(lists, "_row", "inner" if final is None else "left").select("_row", run("t", "found").alias("r")).select("_row", F.col("r.text").alias("t"), "r.done"), "dictionary-round")
        over = step.where("done is null").select("_row", "t")
        final = over if final is None else final.unionAll(over)
        todo = step.where("done is not null")
        if todo.isEmpty():
            break
    changed = texts.join(final, "_row").where("said <> t").select(F.col("said").alias("_said"), F.col("t").alias("_fixed"))
    changed = _written(changed, "dictionary-changes")
    changed = F.broadcast(changed) if changed.limit(_FEW_TEXTS + 1).count() <= _FEW_TEXTS else changed
    return rows.join(changed, F.col(text) == F.col("_said"), "left").withColumn(text, F.coalesce("_fixed", text)).select(*df.columns)


def _next_owners(met: DataFrame, long: DataFrame) -> DataFrame:
    """pattern, done, order, pos: of a pattern's entries the first behind done, by one pass over them in order."""
    asked = met.select("pattern", "done").distinct()
    own = long.join(asked.select("pattern").distinct(), "pattern", "left_semi")
    own = own.select("pattern", F.col("order").alias("at"), F.lit(0).alias("asks"), F.struct("order", "pos").alias("owner"))
    both = own.unionByName(asked.select("pattern", F.col("done").alias("at"), F.lit(1).alias("asks")), allowMissingColumns=True)
    w = Window.partitionBy("pattern").orderBy(F.col("at").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("owner", F.last("owner", ignorenulls=True).over(w)).where("asks = 1 and owner is not null")
    return found.select("pattern", F.col("at").alias("done"), "owner.order", "owner.pos")


def _low(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def merge_dictionary(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """existing with the imported entries whose lower-cased original is new; both sides filled in."""
    new = imported.where(F.coalesce(F.trim("original"), F.lit("")) != "").where(F.coalesce(F.trim("replacement"), F.lit("")) != "")
    new = new.join(existing.select(F.lower("original").alias("_o")).distinct(), F.lower("original") == F.col("_o"), "left_anti")
    new = new.select(F.coalesce("id", F.sha1(F.lower("original"))).alias("id"), "original", "replacement", F.coalesce("variants", generate_variants(F.col("original"))).alias("variants"), F.coalesce("created_at", F.lit(0).cast("timestamp")).alias("created_at"))
    return existing.select("id", "original", "replacement", "variants", "created_at").unionByName(new)


def migrate_dictionary(legacy: DataFrame, value: str = "value") -> DataFrame:
    """A list of words becomes entries that stand for themselves."""
    return legacy.select(F.sha1(value).alias("id"), F.col(value).alias("original"), F.col(value).alias("replacement"), F.array().cast("array<string>").alias("variants"))


def upsert_dictionary(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Edits by id refresh the variants; additions with a known original are refused."""
    changes = changes.select("id", F.coalesce(F.nullif(F.trim("original"), F.lit("")), F.trim("replacement")).alias("original"), F.trim("replacement").alias("replacement"))
    changes = changes.withColumn("variants", generate_variants(F.col("original")))
    others = existing.select(F.col("id").alias("_i"), F.lower("original").alias("_o"))
    ok = changes.join(others, (F.lower("original") == F.col("_o")) & (F.col("id") != F.col("_i")), "left_anti")
    kept = existing.join(ok.select("id"), "id", "left_anti").select("id", "original", "replacement", "variants")
    return kept.unionByName(ok)


def delete_dictionary(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id"), "id", "left_anti")


def boost_terms(dictionary: DataFrame) -> DataFrame:
    return dictionary.select(F.explode(F.array("replacement", "original")).alias("term")).select(F.trim("term").alias("term")).where("term <> ''").distinct()


def export_dictionary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
