"""From recognised segments to transcripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rx import S

# fixed values
CONTINUATIONS = set("""and but or nor of to with from by at into onto upon among amongst between beyond
during except toward towards within without via versus which whom whose than""".split())
THANKS = ["thank you", "thanks", "thank you so much", "thank you very much", "thanks so much"]
LANGUAGES = "en de fr es it pt nl pl uk cs ro hu sv bg da fi el hr lt sk sl et lv no ca".split()
_ENDS = r"[.!?…][\"'”’)\]]*$"
_WORD = re.compile(r"[A-Za-z0-9'’-]+")


def overlap_words(c: Column) -> Column:
    """Comparable words: lower case, one kind of apostrophe."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, "’", "'")), F.lit(r"([a-z0-9'-]+)"), 1)


def restart_overlap(left: Column, right: Column) -> Column:
    """The longest k of 2 to 6 with the last k words of left = the first k of right, else 0."""
    a, b = overlap_words(left), overlap_words(right)
    ks = F.transform(F.sequence(F.lit(2), F.lit(6)), lambda k: F.when((F.size(a) >= k) & (F.size(b) >= k) & (F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k) == F.slice(b, 1, k)), k).otherwise(0))
    return F.coalesce(F.array_max(ks), F.lit(0))


def ends_sentence(c: Column) -> Column:
    return c.rlike(_ENDS)


def last_words(text: str, n: int = 6) -> list[str]:
    """The last n words of a text, found from its end."""
    size = 64
    while True:
        at = max(0, len(text) - size)
        words = list(_WORD.finditer(text, at))
        if at == 0 or len(words) > n:  # the first one may be cut
            return [m[0] for m in words[-n:]]
        size *= 4


def repair_seam(left: str, right: str, forced: bool) -> tuple[str, str, bool, bool]:
    """(left, right, trimmed, repaired) after looking at the seam between two texts."""
    trimmed = repaired = False
    if not forced:
        tail = [w.lower().replace("’", "'") for w in last_words(left)]
        head = list(_WORD.finditer(right))
        said = [m[0].lower().replace("’", "'") for m in head[:6]]
        k = next((k for k in range(min(6, len(tail), len(said)), 1, -1) if tail[-k:] == said[:k]), 0)
        if k:
            rest = right[head[k].start():] if k < len(head) else ""
            if not rest:
                return left, "", True, False
            left, right, trimmed = re.sub(_ENDS, "", left), rest, True
    closed = re.search(_ENDS, left) is not None
    first = re.match(r"[A-Za-z][A-Za-z'’-]*", right)
    if first and (forced or not closed):
        w = first[0]
        acronym = len(w) > 1 and w == w.upper()
        if not acronym and w[0].isupper() and w.lower() in CONTINUATIONS:
            right, repaired = w.lower() + right[first.end():], True
            if forced and closed:
                left = re.sub(r"\.[\"'”’)\]]*$", "", left)
    return left, right, trimmed, repaired


#: A seam looks at six words and a mark; so much of a text is kept open, in words, and as a rule in characters.
_OPEN_WORDS, _OPEN_CHARS = 8, 4000


class SeamFold:
    """Segments of one session joined one by one; text that no seam can change any more is passed on."""

    def __init__(self, tail: str = "", forced: bool = False) -> None:
        self.tail, self.forced, self.repairs, self.trims = tail, forced, 0, 0

    def push(self, text: str | None, forced: bool) -> list[str]:
        """The parts that have become final."""
        text = (text or "").strip()
        if not text:
            return []
        if self.tail:
            self.tail, text, trimmed, repaired = repair_seam(self.tail, text, self.forced)
            self.trims, self.repairs = self.trims + trimmed, self.repairs + repaired
        self.forced = forced
        if text:
            self.tail += " " + text if self.tail else text
        self.tail = re.sub(r"\s+", " ", self.tail)
        return self._settled() if len(self.tail) > _OPEN_CHARS else []

    def _settled(self) -> list[str]:
        size = 800
        while size < len(self.tail):
            cut = self.tail.rfind(" ", 0, len(self.tail) - size)
            if cut > 0 and len(last_words(self.tail[cut:], _OPEN_WORDS)) >= _OPEN_WORDS:
                done, self.tail = self.tail[:cut], self.tail[cut:]
                return [done]
            size *= 2
        return []


def join_segments(df: DataFrame, session: str = "session_id", idx: str = "seg_idx", text: str = "text", forced: str = "forced_split") -> DataFrame:
    """One text a session, with counts of repaired and trimmed seams.

    A fold over partitions sorted by session and segment: rows stream by, and of one session its text is held.
    """
    kind = df.schema[session].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, done, key_type = None, None, [], None

        def row() -> tuple:
            return (current, "".join([*done, fold.tail]).strip(), fold.repairs, fold.trims)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, pa.string(), pa.int64(), pa.int64()], strict=True)], [session, "text", "repairs", "trims"])

        for batch in batches:
            rows, key_type = [], batch.schema.field(session).type
            for key, t, f in zip(*(batch.column(c).to_pylist() for c in (session, text, forced)), strict=True):
                if fold is None or key != current:
                    rows += [row()] if fold else []
                    current, fold, done = key, SeamFold(), []
                done += fold.push(t, bool(f))
            yield out(rows)
        if fold:
            yield out([row()])

    rows = df.select(session, idx, text, forced).repartition(session).sortWithinPartitions(session, idx)
    return rows.mapInArrow(run, f"`{session}` {kind}, text string, repairs long, trims long")


def seam_report(df: DataFrame, session: str = "session_id", idx: str = "seg_idx", text: str = "text", forced: str = "forced_split") -> DataFrame:
    """Each non-empty segment but the first, against the one before it."""
    w = Window.partitionBy(session).orderBy(idx)
    t = df.where(F.trim(text) != "")
    t = t.withColumns({"left": F.lag(text).over(w), "was_forced": F.lag(forced).over(w)}).where("left is not null")
    first = F.regexp_extract(F.trim(text), r"^([A-Za-z][A-Za-z'’-]*)", 1)
    restart = F.when(F.col("was_forced"), 0).otherwise(restart_overlap(F.col("left"), F.col(text)))
    t = t.withColumns({"restart": restart, "left_ends": ends_sentence(F.trim("left"))})
    joins = F.lower(first).isin(sorted(CONTINUATIONS)) & first.rlike("^[A-Z]") & ~((F.length(first) > 1) & (first == F.upper(first)))
    return t.select(session, idx, "was_forced", "left_ends", "restart", ((F.col("restart") == 0) & (F.col("was_forced") | ~F.col("left_ends")) & joins).alias("repaired"))


def dedup_overlap(df: DataFrame, session: str = "session_id", idx: str = "chunk_idx", text: str = "text", window: int = 15, least: int = 3) -> DataFrame:
    """Each chunk without the words that the kept text before it ends with; chunks without words go.

    An ordered fold over partitions sorted by session and chunk: rows stream by, and only the
    last `window` kept words of one session are held.
    """
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in (session, idx)]

    def cut(last: list[str], now: list[str]) -> int:
        low = [w.lower() for w in now[:window]]
        return next((k for k in range(min(window, len(last), len(low)), least - 1, -1) if last[-k:] == low[:k]), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = object(), []
        for batch in batches:
            stay, texts = [], []
            for n, (s, t) in enumerate(zip(batch.column(session).to_pylist(), batch.column(text).to_pylist(), strict=True)):
                if s != current:
                    current, last = s, []
                words = re.findall(r"\S+", t or "", re.A)
                if words:
                    kept = words[cut(last, words):]
                    last = [w.lower() for w in kept[-window:]] or last
                    stay.append(n)
                    texts.append(" ".join(kept))
            out = batch.select([session, idx]).take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(texts, pa.string())], [session, idx, text])

    rows = df.select(session, idx, text)
    return rows.repartition(session).sortWithinPartitions(session, idx).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds) + f", `{text}` string")


def _runs(words: list[str], least: int = 4, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, period, end) of phrases of `least` words or more said `times` times in a row."""
    _, ids = np.unique(words, return_inverse=True)
    out, at = [], 0
    found: list[tuple[int, int, int]] = []
    for p in range(least, len(ids) // times + 1):
        same = ids[p:] == ids[:-p]
        if not same[p * (times - 2)::p].any():  # a run of that length would have a place among every p-th
            continue
        same = np.concatenate(([False], same, [False])).astype(np.int8)
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= p * (times - 1):
                found.append((a, p, a + p * ((b - a) // p + 1)))
    for a, p, b in sorted(found):
        if a >= at:
            out.append((a, p, b))
            at = b
    return out


def _collapsed(t: str) -> str:
    spans = [m.span() for m in re.finditer(r"[\w']+", t, re.A)]
    gaps_ok = [not t[a[1]:b[0]].strip() for a, b in zip(spans, spans[1:])]
    words = [t[a:b].lower() for a, b in spans]
    out, last = [], 0
    for a, p, b in _runs(words):
        if all(gaps_ok[a:b - 1]):
            out += [t[last:spans[a + p - 1][1]]]
            last = spans[b - 1][1]
    return ("".join(out) + t[last:]).strip() if out else t


def collapse_repetition_loop(c: Column) -> Column:
    """Keep the first copy of a looping phrase: a period search over word numbers, linear per period."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_collapsed, na_action="ignore")

    return F.when(F.length(c) >= 24, run(c)).otherwise(c)


def detect_repetition_loop(c: Column) -> Column:
    return (F.length(c) >= 50) & (collapse_repetition_loop(c) != c)


def choose_retry(df: DataFrame, keys: tuple[str, ...] = ("session_id", "chunk_idx")) -> DataFrame:
    """Of two attempts (attempt 0, 1; text, looping, collapsed): a clean retry, else the longer collapsed text."""
    a = df.where("attempt = 0").select(*keys, F.col("text").alias("t0"), F.col("looping").alias("l0"), F.col("collapsed").alias("c0"))
    b = df.where("attempt = 1").select(*keys, F.col("text").alias("t1"), F.col("looping").alias("l1"), F.col("collapsed").alias("c1"))
    longer = F.when(F.length("c1") > F.length("c0"), F.col("c1")).otherwise(F.col("c0"))
    pick = F.when(~F.col("l0") | F.col("t1").isNull(), F.when(F.col("l0"), F.col("c0")).otherwise(F.col("t0"))).when(~F.col("l1"), F.col("t1")).otherwise(longer)
    return a.join(b, list(keys), "left").select(*keys, pick.alias("text"))


def suppress_short_thanks(df: DataFrame, text: str = "text", primary_empty: str = "primary_empty", audio_s: str = "audio_s") -> DataFrame:
    said = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[.,!?]+$", ""))
    return df.withColumn(text, F.when(F.col(primary_empty) & (F.col(audio_s) < 2) & said.isin(THANKS), "").otherwise(F.col(text)))


def context_prompt(c: Column) -> Column:
    sentence = F.trim(F.regexp_extract(c, r"([^.!?]*[.!?]\s*)$", 1))
    return F.when(F.length(sentence) > 10, F.substring(sentence, 1, 224)).otherwise(F.trim(F.substring(c, F.greatest(F.length(c) - 199, F.lit(1)), F.lit(200))))


def with_context(df: DataFrame, session: str = "session_id", idx: str = "chunk_idx", text: str = "text") -> DataFrame:
    """Each chunk with the prompt of the last non-empty chunk before it."""
    prompt = F.when(F.col(text) != "", context_prompt(F.col(text)))
    w = Window.partitionBy(session).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("prompt", F.coalesce(F.last(prompt, ignorenulls=True).over(w), F.lit("")))


def engine_fallback(sessions: DataFrame, streamed: DataFrame, primary: DataFrame, secondary: DataFrame, session: str = "session_id") -> DataFrame:
    """A healthy, non-empty streamed text; else the primary's; else the secondary's."""
    s = streamed.where("healthy").select(session, F.col("text").alias("s"))
    p, q = primary.select(session, F.col("text").alias("p")), secondary.select(session, F.col("text").alias("q"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    j = sessions.select(session).join(s, session, "left").join(p, session, "left").join(q, session, "left")
    engine = F.when(some("s").isNotNull(), "stream").when(some("p").isNotNull(), "primary").when(some("q").isNotNull(), "secondary").otherwise("none")
    return j.select(session, F.coalesce(some("s"), some("p"), some("q"), F.lit("")).alias("text"), engine.alias("engine"))


def route_by_language(df: DataFrame, lang: str = "lang") -> DataFrame:
    table = df.sparkSession.createDataFrame([(x,) for x in [*LANGUAGES, "auto"]], "code string")
    j = df.join(F.broadcast(table), F.col(lang) == F.col("code"), "left")
    return j.withColumn("engine", F.when(F.col("code").isNotNull(), "primary").otherwise("secondary")).drop("code")


def tokens_to_text(tokens: DataFrame, vocab: DataFrame, key: str = "segment_id", pos: str = "pos") -> DataFrame:
    """Ordered ids -> text; `<...>` pieces are left out."""
    pieces = tokens.join(vocab, tokens["token"] == vocab["id"]).where(~F.col("piece").rlike("^<.*>$"))
    t = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "piece"))), lambda x: F.replace(x["piece"], F.lit("▁"), F.lit(" "))), "").alias("text"))
    # a space that no word character follows goes
    t = t.withColumn("text", F.regexp_replace("text", r"^\s|\s(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])\B\s", ""))
    t = t.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"^[\s.]+", ""), r"\.{3,}", "..."))
    return t.withColumn("text", F.trim("text"))


#: Encoder frames of 1280 samples in a second; token times are numbers of frames, which compare exactly.
FRAMES_A_SECOND = 16_000 / 1280


def _longest_run(match: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of the longest diagonal of matches, the first of those."""
    best: tuple[int, int, int] = (0, 0, 0)
    run: dict[tuple[int, int], int] = {}
    for i, j in np.argwhere(match)[::-1].tolist():
        n = run[i, j] = run.get((i + 1, j + 1), 0) + 1
        if n >= best[0]:
            best = (n, i, j)
    n, i, j = best
    return [(i + k, j + k) for k in range(n)]


def _common(match: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence."""
    i, j = match.shape
    best = np.zeros((i + 1, j + 1), int)
    for k in range(1, i + 1):
        best[k, 1:] = np.maximum.accumulate(np.maximum(best[k - 1, 1:], best[k - 1, :-1] + match[k - 1]))
    pairs: list[tuple[int, int]] = []
    while i and j:
        if match[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i - 1, j] > best[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _merge_pair(left: np.ndarray, right: np.ndarray, overlap: float) -> np.ndarray:
    """Rows of (token, timestamp, duration): align two windows that overlap in time."""
    if not len(left) or not len(right):
        return right if not len(left) else left
    lt, rt, reach = left[:, 1], right[:, 1], overlap * FRAMES_A_SECOND
    end, begin = lt[-1] + 1, rt[0]
    if end <= begin:
        return np.concatenate((left, right))
    by_time = lambda: np.concatenate((left[2 * lt <= end + begin], right[2 * rt >= end + begin]))
    li, ri = np.flatnonzero(lt + 1 > begin - reach), np.flatnonzero(rt < end + reach)
    if len(li) < 2 or len(ri) < 2:
        return by_time()
    match = (left[li, 0][:, None] == right[ri, 0]) & (np.abs(lt[li][:, None] - rt[ri]) < reach / 2)
    pairs = _longest_run(match)
    if len(pairs) < max(len(li) // 2, 1):
        pairs = _common(match)
    if not pairs:
        return by_time()
    at = [(int(li[i]), int(ri[j])) for i, j in pairs]
    if at[-1][0] - at[0][0] == at[-1][1] - at[0][1] == len(at) - 1:  # no gaps
        return np.concatenate((left[:at[-1][0] + 1], right[at[-1][1] + 1:]))
    out = [left[:at[0][0]]]
    for (a, b), nxt in zip(at, [*at[1:], None]):
        out.append(left[a:a + 1])
        if nxt:
            gap_l, gap_r = left[a + 1:nxt[0]], right[b + 1:nxt[1]]
            out.append(gap_r if len(gap_r) > len(gap_l) else gap_l)
    out.append(right[at[-1][1] + 1:])
    return np.concatenate(out)


class TokenFold:
    """Windows of one session merged one by one; tokens that no later window reaches are passed on.

    Windows come in order of their begin.  A window changes tokens that end less than the overlap before its begin
    at most, so what is older is final, and the fold holds the rest only.
    """

    def __init__(self, overlap: float) -> None:
        self.overlap, self.held = overlap, np.zeros((0, 3), np.int64)

    def push(self, window: np.ndarray) -> np.ndarray:
        """The (token, timestamp, duration) that have become final, by time."""
        final = self.held[:0]
        if len(window) and len(self.held):
            old = self.held[:, 1] + 1 <= window[0, 1] - self.overlap * FRAMES_A_SECOND
            final, self.held = _by_time(self.held[old]), self.held[~old]
        self.held = _merge_pair(self.held, window, self.overlap)
        return final

    def finish(self) -> np.ndarray:
        return _by_time(self.held)


def _by_time(tokens: np.ndarray) -> np.ndarray:
    return tokens[np.argsort(tokens[:, 1], kind="stable")]


def _changes(c: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it, and the first place."""
    if not len(c):
        return np.zeros(0, bool)
    now, before = c.slice(1), c.slice(0, len(c) - 1)
    differs = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.not_equal(now.is_null(), before.is_null()))
    return np.concatenate(([True], differs.to_numpy(zero_copy_only=False)))


def merge_token_chunks(df: DataFrame, overlap_s: float = 2.0, session: str = "session_id") -> DataFrame:
    """session_id, pos, token, timestamp, duration of overlapping windows put together, in order of time.

    A fold over partitions sorted by session, window and place: rows stream by, and only a
    window and the tokens that it can reach are held.
    """
    kind = df.schema[session].dataType.simpleString()
    names = [session, "pos", "token", "timestamp", "duration"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, current, chunk, parts, given, keys = None, None, None, [], 0, None
        done: list[tuple] = []  # (session, position of the first, tokens)

        def give(tokens: np.ndarray) -> None:
            nonlocal given
            if len(tokens):
                done.append((current, given, tokens))
                given += len(tokens)

        def out() -> pa.RecordBatch:
            sizes = [len(t) for *_, t in done]
            ids = pa.array([s for s, *_ in done], keys).take(pa.array(np.repeat(np.arange(len(done)), sizes), pa.int64()))
            pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + n) for (_, a, _), n in zip(done, sizes, strict=True))])
            tokens = np.concatenate([np.zeros((0, 3), np.int64), *(t for *_, t in done)])
            done.clear()
            return pa.RecordBatch.from_arrays([ids, pa.array(pos), *(pa.array(np.ascontiguousarray(c)) for c in tokens.T)], names)

        for batch in batches:
            keys = batch.schema.field(session).type
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "timestamp", "duration")], axis=1)
            edges = np.flatnonzero(_changes(batch.column(session)) | _changes(batch.column("chunk_idx")))
            starts = pa.array(edges, pa.int64())
            ids, windows = batch.column(session).take(starts).to_pylist(), batch.column("chunk_idx").take(starts).to_pylist()
            for key, window, a, b in zip(ids, windows, edges.tolist(), [*edges[1:].tolist(), len(rows)], strict=True):
                if fold is None or (key, window) != (current, chunk):
                    if fold is not None:
                        give(fold.push(np.concatenate(parts)))
                    if fold is None or key != current:
                        if fold is not None:
                            give(fold.finish())
                        fold, current, given = TokenFold(overlap_s), key, 0
                    chunk, parts = window, []
                parts.append(rows[a:b])
            yield out()
        if fold is not None:
            give(fold.push(np.concatenate(parts)))
            give(fold.finish())
            yield out()

    rows = df.select(session, "chunk_idx", "pos", "token", "timestamp", "duration").repartition(session).sortWithinPartitions(session, "chunk_idx", "pos")
    return rows.mapInArrow(run, f"`{session}` {kind}, pos long, token long, timestamp long, duration long")


def content_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def word_loss(df: DataFrame, said: str, heard: str, key: str) -> DataFrame:
    """How many words of said heard lacks, copies counted, and the reverse."""
    j = df.select(key, content_words(F.col(said)).alias("wa"), content_words(F.col(heard)).alias("wb"))
    long = j.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("wa").alias("w")), F.struct(F.lit(1).alias("side"), F.col("wb").alias("w")))).alias("x")).select(key, "x.side", F.explode("x.w").alias("w"))
    n = long.groupBy(key, "w").agg(F.sum((F.col("side") == 0).cast("int")).alias("a"), F.sum("side").alias("b"))
    n = n.groupBy(key).agg(F.sum("a").cast("int").alias("n_said"), F.sum("b").cast("int").alias("n_heard"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).cast("int").alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).cast("int").alias("extra"))
    return df.select(key).join(n, key, "left").fillna(0)
