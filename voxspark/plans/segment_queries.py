"""Queries of the segment operators, over conversations and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import segments as seg
from .registry import query
from .text_queries import table


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_idx"), "text", (F.col("turn") % 3 == 0).alias("forced_split"))


_OVERLAP = """(SELECT coalesce(max(k), 0) FROM (SELECT unnest(range(2, 7)) AS k) WHERE len({a}) >= k AND len({b}) >= k AND {a}[len({a}) - k + 1:] = {b}[:k])"""
_WORDS = "regexp_extract_all(lower(replace({}, '’', '''')), '[a-z0-9''-]+')"


@query(f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), p AS (SELECT doc_id, w AS a, w[greatest(len(w) - doc_id % 8 + 1, 1):] || ['tail'] AS b FROM d) SELECT doc_id, {_OVERLAP.format(a='a', b='b')}::INTEGER AS k FROM p")
def b01_restart_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", seg.overlap_words(F.col("text")).alias("w"))
    n = (F.col("doc_id") % 8).cast("int")
    right = F.array_join(F.concat(F.when(n == 0, F.array().cast("array<string>")).otherwise(F.slice("w", F.greatest(F.size("w") - n + 1, F.lit(1)), F.greatest(n, F.lit(1)))), F.array(F.lit("tail"))), " ")
    return d.select("doc_id", seg.restart_overlap(F.array_join("w", " "), right).alias("k"))


@query()
def b03_join_segments(spark, sf_dir):
    return seg.join_segments(_turns(spark, sf_dir))


@query("WITH t AS (SELECT conv_id AS session_id, turn, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS text FROM conversations WHERE regexp_matches(text, '[^\\s]')) SELECT session_id, string_agg('segment ' || turn || ' says ' || length(text) || '.', ' ' ORDER BY turn) AS text, 0::BIGINT AS repairs, 0::BIGINT AS trims FROM t GROUP BY session_id")
def b02_b03_join_plain_segments(spark, sf_dir):
    """Sentences that no seam rule touches: the join is the list."""
    t = _turns(spark, sf_dir).where(F.col("text").rlike(r"\S"))
    said = F.concat(F.lit("Segment "), F.col("seg_idx").cast("string"), F.lit(" says "), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("string"), F.lit("."))
    return seg.join_segments(t.withColumn("text", said).withColumn("forced_split", F.lit(False))).withColumn("text", F.regexp_replace("text", "Segment", "segment"))


#: Known cuts of known sentences, N a number: segments, which of them were cut by force, the joined text, repairs, trims.
_SEAMS = (
    (("I sent N boxes", "And billed N more"), (), "I sent N boxes and billed N more", 1, 0),
    (("Would you.", "Would you like N cups?"), (), "Would you like N cups?", 0, 1),
    (("The total is N.", "And it grew"), (0,), "The total is N and it grew", 1, 0),
    (("We should ship N", "ship N today"), (0,), "We should ship N ship N today", 0, 0),
    (("Order N left.", "But it came back."), (), "Order N left. But it came back.", 0, 0),
    (("He sat in", "US offices of N", "   ", "With  staff"), (), "He sat in US offices of N with staff", 1, 0),
    (("Can you send me the N.", "Send me the N now.", "To Paris"), (), "Can you send me the N now. To Paris", 0, 1),
    (("I called N", "And asked about it", "But they left", "But they left early."), (), "I called N and asked about it but they left early.", 2, 1),
    (("He said \"no N.\"", "And left"), (), "He said \"no N.\" And left", 0, 0),
    (("She flew to", "Paris for N", "Than", "than home"), (), "She flew to Paris for N than than home", 1, 0),
    (("Stop at N.", "Stop at N."), (), "Stop at N.", 0, 1),
)
#: So many plain sentences stand before the known cuts of every 50th session, so that a part of its text is final early.
_PLAIN = 200


def known_segments(spark, sf_dir):
    """session_id, seg_idx, text, forced_split of the known cuts, one session a customer."""
    k = F.col("c_custkey")
    case = F.array(*(F.struct(F.array(*map(F.lit, texts)).alias("texts"), F.array(*(F.lit(i in forced) for i in range(len(texts)))).alias("forced")) for texts, forced, *_ in _SEAMS))
    o = table(spark, sf_dir, "customer").select(k.alias("session_id"), F.get(case, (k % len(_SEAMS)).cast("int")).alias("c"), F.when(k % 50 == 0, _PLAIN).otherwise(0).alias("plain"))
    numbered = lambda t: F.replace(t, F.lit("N"), F.col("session_id").cast("string"))
    plain = F.when(F.col("plain") > 0, F.transform(F.sequence(F.lit(1), F.col("plain")), lambda i: F.struct(F.concat(F.lit("Item "), i.cast("string"), F.lit(" of this list is done.")).alias("text"), F.lit(False).alias("forced_split")))).otherwise(F.array().cast("array<struct<text:string,forced_split:boolean>>"))
    own = F.zip_with("c.texts", "c.forced", lambda t, f: F.struct(numbered(t).alias("text"), f.alias("forced_split")))
    return o.select("session_id", F.posexplode(F.concat(plain, own)).alias("seg_idx", "s")).select("session_id", F.col("seg_idx").cast("long").alias("seg_idx"), "s.*")


def _quoted(x):
    return "'" + x.replace("'", "''") + "'"


_SEAM_SQL = f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"({k}, {_quoted(joined)}, {repairs}, {trims}, {sum(bool(t.strip()) for t in texts)}, {len(texts)})" for k, (texts, _, joined, repairs, trims) in enumerate(_SEAMS))}) v(k, joined, repairs, trims, said, parts)),
p AS (SELECT string_agg('Item ' || i || ' of this list is done.', ' ' ORDER BY i) AS plain FROM (SELECT unnest(range(1, {_PLAIN} + 1)) AS i)),
j AS (SELECT c_custkey AS session_id, CASE WHEN c_custkey % 50 = 0 THEN plain || ' ' ELSE '' END || replace(joined, 'N', c_custkey::VARCHAR) AS text, repairs::BIGINT AS repairs, trims::BIGINT AS trims, (parts + CASE WHEN c_custkey % 50 = 0 THEN {_PLAIN} ELSE 0 END)::BIGINT AS segments
FROM customer JOIN c ON c.k = c_custkey % {len(_SEAMS)}, p)"""


@query(f"{_SEAM_SQL} SELECT session_id, text, repairs, trims FROM j")
def b03_known_seams(spark, sf_dir):
    """Seams that each of the rules touches, or leaves."""
    return seg.join_segments(known_segments(spark, sf_dir))


@query(rf"""WITH t AS (SELECT conv_id AS session_id, turn AS seg_idx, text, turn % 3 = 0 AS forced FROM conversations WHERE trim(text, ' ') <> ''),
l AS (SELECT *, lag(text) OVER w AS l, lag(forced) OVER w AS was_forced FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seg_idx)),
p AS (SELECT *, {_WORDS.format('l')} AS a, {_WORDS.format('text')} AS b, regexp_extract(trim(text, ' '), '^([A-Za-z][A-Za-z''’-]*)', 1) AS f, regexp_matches(trim(l, ' '), '[.!?…]["''”’)\]]*$') AS left_ends FROM l WHERE l IS NOT NULL),
k AS (SELECT *, CASE WHEN was_forced THEN 0 ELSE {_OVERLAP.format(a='a', b='b')} END AS restart FROM p)
SELECT session_id, seg_idx, was_forced, left_ends, restart::INTEGER AS restart,
  restart = 0 AND (was_forced OR NOT left_ends) AND lower(f) IN ({', '.join(f"'{w}'" for w in sorted(seg.CONTINUATIONS))}) AND regexp_matches(f, '^[A-Z]') AND NOT (length(f) > 1 AND f = upper(f)) AS repaired FROM k""")
def b04_seam_report(spark, sf_dir):
    return seg.seam_report(_turns(spark, sf_dir))


def _windows(spark, sf_dir):
    """Documents of distinct words cut into chunks of twelve that share four."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("w"))
    d = d.withColumn("w", F.transform("w", lambda x, i: F.concat(x, i.cast("string")))).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - 12) / 8), F.lit(0)).cast("int")
    return d.select("session_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx")).select("session_id", "chunk_idx", F.slice("w", F.col("chunk_idx") * 8 + 1, 12).alias("w"))


@query(r"SELECT doc_id AS session_id, array_to_string(list_transform(w, lambda x, i: x || (i - 1)), ' ') AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\s]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0")
def b05_dedup_overlap(spark, sf_dir):
    kept = seg.dedup_overlap(_windows(spark, sf_dir).withColumn("text", F.array_join("w", " ")))
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "text")))
    return kept.where("text <> ''").groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def _loops(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    phrase = F.concat(F.lit("we want part "), F.col("p_partkey").cast("string"))
    n = (F.col("p_partkey") % 6).cast("int")
    return p.withColumn("text", F.concat(F.lit("so now "), F.array_join(F.array_repeat(phrase, n), " "), F.lit(" and that will be all for today then")))


@query("SELECT p_partkey, p_partkey % 6 >= 3 AS looping FROM part")
def b06_detect_repetition_loop(spark, sf_dir):
    return _loops(spark, sf_dir).select("p_partkey", seg.detect_repetition_loop(F.col("text")).alias("looping"))


@query("SELECT p_partkey, 'so now ' || CASE p_partkey % 6 WHEN 0 THEN '' WHEN 2 THEN 'we want part ' || p_partkey || ' we want part ' || p_partkey ELSE 'we want part ' || p_partkey END || ' and that will be all for today then' AS text FROM part")
def b07_collapse_repetition_loop(spark, sf_dir):
    return _loops(spark, sf_dir).select("p_partkey", seg.collapse_repetition_loop(F.col("text")).alias("text"))


@query("""WITH t AS (SELECT o_orderkey AS k, 'a' || o_orderkey AS t0, o_orderkey % 2 = 0 AS l0, repeat('x', (o_orderkey % 5)::INT) AS c0, 'b' || o_orderkey AS t1, o_orderkey % 3 = 0 AS l1, repeat('y', (o_orderkey % 7)::INT) AS c1 FROM orders)
SELECT k AS session_id, 0 AS chunk_idx, CASE WHEN NOT l0 THEN t0 WHEN NOT l1 THEN t1 WHEN length(c1) > length(c0) THEN c1 ELSE c0 END AS text FROM t""")
def b08_choose_retry(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    rows = [o.select(k.alias("session_id"), F.lit(0).alias("chunk_idx"), F.lit(a).alias("attempt"), F.concat(F.lit("ab"[a]), k.cast("string")).alias("text"), (k % (2 + a) == 0).alias("looping"), F.call_function("repeat", F.lit("xy"[a]), (k % (5 + 2 * a)).cast("int")).alias("collapsed")) for a in (0, 1)]
    return seg.choose_retry(rows[0].unionAll(rows[1]))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 < 2 AND o_orderkey % 3 < 2 THEN '' WHEN o_orderkey % 3 = 0 THEN 'Thank you.' WHEN o_orderkey % 3 = 1 THEN ' thanks so much!! ' ELSE 'Thank you, all' END AS text FROM orders")
def b09_suppress_short_thanks(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "Thank you.").when(k % 3 == 1, " thanks so much!! ").otherwise("Thank you, all").alias("text"), (k % 2 == 0).alias("primary_empty"), (k % 5).cast("double").alias("audio_s"))
    return seg.suppress_short_thanks(o).select("o_orderkey", "text")


@query(r"""WITH p AS (SELECT conv_id, turn, text, trim(regexp_extract(text, '[^.!?]*[.!?]\s*$'), ' ') AS s FROM conversations),
q AS (SELECT conv_id, turn, CASE WHEN text = '' THEN NULL WHEN length(s) > 10 THEN s[:224] ELSE trim(text[greatest(length(text) - 199, 1):], ' ') END AS prompt FROM p)
SELECT conv_id AS session_id, turn AS seg_idx, coalesce(last_value(prompt IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prompt FROM q""")
def b10_with_context(spark, sf_dir):
    return seg.with_context(_turns(spark, sf_dir), idx="seg_idx").select("session_id", "seg_idx", "prompt")


@query("""SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 's' || o_orderkey WHEN o_orderkey % 5 <> 0 THEN 'p' || o_orderkey WHEN o_orderkey % 7 <> 0 THEN 'q' || o_orderkey ELSE '' END AS text,
CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'stream' WHEN o_orderkey % 5 <> 0 THEN 'primary' WHEN o_orderkey % 7 <> 0 THEN 'secondary' ELSE 'none' END AS engine FROM orders""")
def b11_engine_fallback(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("session_id"), k)
    name = lambda x: F.concat(F.lit(x), k.cast("string"))
    s = o.select("session_id", F.when(k % 3 == 0, "  ").otherwise(name("s")).alias("text"), (k % 2 == 0).alias("healthy"))
    return seg.engine_fallback(o, s, o.select("session_id", F.when(k % 5 == 0, "").otherwise(name("p")).alias("text")), o.where(k % 7 != 0).select("session_id", name("q").alias("text")))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ja' WHEN doc_id % 4 = 1 THEN 'auto' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 OR lang NOT IN ('en','de','fr','es','it','pt') AND doc_id % 4 <> 1 THEN 'secondary' ELSE 'primary' END AS engine FROM documents")
def b12_route_by_language(spark, sf_dir):
    i = F.col("doc_id")
    return seg.route_by_language(table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 0, "ja").when(i % 4 == 1, "auto").otherwise(F.col("lang")).alias("lang")))


@query("SELECT p_partkey AS segment_id, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM part")
def b13_tokens_to_text(spark, sf_dir):
    """Names cut into word starts and rests, with special pieces between; numbered and put together."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment_id"), F.explode(F.filter(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "), " "), lambda w: w != "")).alias("w"), "p_name")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment_id"), F.posexplode(F.filter(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "), " "), lambda w: w != "")).alias("i", "w"))
    rows = p.select("segment_id", "i", F.posexplode(F.array(F.concat(F.lit("▁"), F.substring("w", 1, 2)), F.lit("<blank>"), F.substring("w", 3, 100))).alias("j", "piece")).where("piece <> ''")
    vocab = rows.select("piece").distinct().select(F.xxhash64("piece").alias("id"), "piece")
    return seg.tokens_to_text(rows.select("segment_id", (F.col("i") * 3 + F.col("j")).alias("pos"), F.xxhash64("piece").alias("token")), vocab)


@query(r"WITH w AS (SELECT doc_id, unnest(range(len(regexp_split_to_array(trim(text, ' '), '[\s]+')))) AS pos FROM documents) SELECT doc_id AS session_id, pos::BIGINT AS pos, pos::BIGINT * 5 AS timestamp, (doc_id * 31 + pos * 7) % 1000 AS token FROM w")
def b14_merge_token_chunks(spark, sf_dir):
    """A token list cut into windows that overlap by two seconds merges to itself."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    d = d.select("session_id", "i", (F.col("i").cast("long") * 5).alias("timestamp"), ((F.col("session_id") * 31 + F.col("i") * 7) % 1000).cast("long").alias("token"))
    d = d.withColumn("chunk_idx", F.explode(F.array_distinct(F.array(F.floor(F.col("i") / 20), F.greatest(F.floor((F.col("i") - 5) / 20), F.lit(0))))))
    return seg.merge_token_chunks(d.select("session_id", "chunk_idx", F.col("i").alias("pos"), "token", "timestamp", F.lit(1).cast("long").alias("duration"))).select("session_id", "pos", "timestamp", "token")


_LISTED = r"WITH w AS (SELECT doc_id, unnest(range(len(regexp_split_to_array(trim(text, ' '), '[\s]+')))) AS pos FROM documents)"


@query(_LISTED + " SELECT doc_id AS session_id, pos::BIGINT AS pos, (doc_id * 31 + pos * 7) % 1000 AS token FROM w")
def b14_merge_jittered_chunks(spark, sf_dir):
    """The same where a window hears its words a frame later than the one before it, and mishears its second word."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    i = F.col("i")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    d = d.select("session_id", "i", ((F.col("session_id") * 31 + i * 7) % 1000).cast("long").alias("token"))
    d = d.withColumn("chunk_idx", F.explode(F.array_distinct(F.array(F.floor(i / 20), F.greatest(F.floor((i - 5) / 20), F.lit(0))))))
    # not in a last window of one or two words, which is too short to be aligned
    odd = (F.col("chunk_idx") > 0) & (F.col("chunk_idx") * 20 + 2 <= F.max("i").over(Window.partitionBy("session_id")))
    wrong = odd & (i == F.col("chunk_idx") * 20 + 1)
    d = d.withColumns({"timestamp": i.cast("long") * 5 + F.when(odd, F.col("chunk_idx") % 2).otherwise(0), "token": F.when(wrong, F.col("token") + 2000).otherwise(F.col("token"))})
    return seg.merge_token_chunks(d.select("session_id", "chunk_idx", i.alias("pos"), "token", "timestamp", F.lit(1).cast("long").alias("duration"))).select("session_id", "pos", "token")


@query(r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS n, coalesce(sum(n) FILTER (w IN ('the', 'de')), 0) AS m FROM c GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_said, coalesce(n - m + 1, 1)::INTEGER AS n_heard, coalesce(m, 0)::INTEGER AS missing, 1::INTEGER AS extra FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id")
def b15_word_loss(spark, sf_dir):
    heard = F.concat(F.array_join(F.filter(seg.content_words(F.col("text")), lambda w: ~w.isin("the", "de")), " "), F.lit(" zzextra"))
    return seg.word_loss(table(spark, sf_dir, "documents").select("doc_id", "text", heard.alias("heard")), "text", "heard", "doc_id")
