"""Queries of the streaming operators: streams over files written from the driver tables, and batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pipeline import postprocess
from ..sources import files
from ..streaming import streams as st
from .audio_queries import chunks
from .decode_queries import _E
from .decode_queries import events as diag_events
from .registry import query
from .segment_queries import _SEAM_SQL, _turns, known_segments
from .text_queries import SPOKEN_ORDERS_SQL, _docs, spoken_orders, table


def _stream(spark, df, name):
    path = files.work_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


_FILES = 4
#: So many rows a file make it certain enough that none of a step's files stays empty.
_ROWS_A_FILE = 1000


def _fed(spark, df, name, steps):
    """A stream of df in `steps` micro-batches, by its column step (0, 1, ...)."""
    path, staged = files.work_path(spark, name), files.work_path(spark, f"{name}-staged")
    df.write.partitionBy("step").parquet(staged)  # so that df is computed once
    rows = spark.read.schema(df.schema).parquet(staged)
    sizes = {r["step"]: r["count"] for r in rows.groupBy("step").count().collect()}
    # as many files for each step as a micro-batch takes
    n = max(_FILES, min(spark.sparkContext.defaultParallelism, min(sizes.values(), default=0) // _ROWS_A_FILE))
    for k in range(steps):
        rows.where(F.col("step") == k).drop("step").repartition(n).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("step").schema).option("maxFilesPerTrigger", n).parquet(path)


def _by_time(df, steps, ts="ts"):
    """The column step: equal shares of the time from the first row to the last, which is written down first."""
    low, high = df.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    return df.withColumn("step", F.least(F.lit(steps - 1), F.floor((F.unix_micros(ts) - low) * steps / (high - low + 1))).cast("int"))


@query()
def g01_stream_segments(spark, sf_dir):
    """The stream's segments equal those of the batch job (c06)."""
    c = chunks(spark, sf_dir).withColumns({"stop": F.lit(False), "abort": F.lit(False)})
    end = c.groupBy("session_id").agg((F.max("chunk_idx") + 1).alias("chunk_idx")).select("session_id", "chunk_idx", F.lit(1000).alias("sample_rate"), F.lit(None).cast("array<float>").alias("samples"), F.lit(True).alias("stop"), F.lit(False).alias("abort"))
    s = _stream(spark, c.unionByName(end), "chunks")
    out = files.work_path(spark, "segments")
    st.run_once(st.stream_segments(s, preview_ms=st.PREVIEW_MS), out)
    return spark.read.parquet(out)


#: Utterances of a session: event_id gives the number of loud chunks (1.024 s of 128 samples), a quiet one follows.
_LOUD = "CASE WHEN event_id % 50 = 0 THEN 20 ELSE 1 + event_id % 9 END"
_SAID = f"SELECT user_id AS session_id, event_id, l, coalesce(sum(l + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT *, {_LOUD} AS l FROM events)"
#: 15 loud chunks (1920 samples) pass the soft limit of 15 s and are cut at the last window of 4 samples; two loud chunks are each session's tail.
_CUT = f"""p AS ({_SAID}), e AS (SELECT session_id, max(before + l + 1) AS n FROM p GROUP BY 1),
c AS (SELECT session_id, before * 128 AS start_sample, CASE WHEN l < 15 THEN (before + l + 1) * 128 ELSE before * 128 + 1916 END AS end_sample, l >= 15 AS forced FROM p
  UNION ALL SELECT session_id, before * 128 + 1916, (before + l + 1) * 128, false FROM p WHERE l >= 15
  UNION ALL SELECT session_id, n * 128, (n + 2) * 128, false FROM e WHERE {{tail}}),
s AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY start_sample) - 1)::BIGINT AS seg_idx, start_sample::BIGINT AS start_sample, end_sample::BIGINT AS end_sample, forced FROM c)"""


def _utterances(spark, sf_dir):
    """session_id, chunk_idx, sample_rate, samples of known utterances, with two loud chunks at the end; n: chunks of the session."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.expr(_LOUD).cast("long").alias("l"))
    e = e.withColumn("before", F.coalesce(F.sum(F.col("l") + 1).over(w), F.lit(0)))
    said = e.select("session_id", "before", "l", F.explode(F.sequence(F.lit(0), F.col("l"))).alias("i")).select("session_id", (F.col("before") + F.col("i")).alias("chunk_idx"), (F.col("i") < F.col("l")).alias("loud"))
    ends = e.groupBy("session_id").agg(F.max(F.col("before") + F.col("l") + 1).alias("n"))
    tail = ends.select("session_id", F.explode(F.array(F.col("n"), F.col("n") + 1)).alias("chunk_idx"), F.lit(True).alias("loud"))
    wave = lambda x: F.array_repeat(F.lit(x).cast("float"), 128)
    rows = said.unionByName(tail).withColumns({"sample_rate": F.lit(125), "samples": F.when(F.col("loud"), wave(0.15)).otherwise(wave(0.0005))}).drop("loud")
    return rows, ends.select("session_id", (F.col("n") + 2).alias("chunk_idx"))


@query(f"WITH {_CUT.format(tail='true')} SELECT * FROM s")
def c06_known_utterances(spark, sf_dir):
    from ..operators import audio

    return audio.segment_by_energy(_utterances(spark, sf_dir)[0])


def _ended(spark, sf_dir, how):
    """The utterances as a stream in five micro-batches of about 100 s; how: stop, abort or null of a session's last row.

    Some chunks come with the step behind theirs, so that those after them come too early.  A last row
    far ahead in time lets the watermark pass all.
    """
    rows, ends = _utterances(spark, sf_dir)
    rows = rows.withColumns({"stop": F.lit(False), "abort": F.lit(False)})
    ends = ends.withColumns({"sample_rate": F.lit(125), "samples": F.lit(None).cast("array<float>"), "stop": how == "stop", "abort": how == "abort"}).where(how.isNotNull())
    i = F.col("chunk_idx")
    step = F.least(F.lit(4), F.floor(i / 100) + (i % 100 == 97).cast("int")).cast("int")
    rows = rows.unionByName(ends).withColumns({"ts": F.timestamp_seconds(i + 1_700_000_000), "step": step})
    last = spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(0).cast("long").alias("chunk_idx"), F.lit(125).alias("sample_rate"), F.lit(None).cast("array<float>").alias("samples"), F.lit(True).alias("stop"), F.lit(False).alias("abort"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"), F.lit(4).alias("step"))
    return _fed(spark, rows.unionByName(last), "utterances", 5)


@query(f"WITH {_CUT.format(tail='true')} SELECT * FROM s")
def g01_known_utterances(spark, sf_dir):
    """The segments of c06_known_utterances, from a stream."""
    out = files.work_path(spark, "known-segments")
    st.run_once(st.stream_segments(_ended(spark, sf_dir, F.lit("stop"))), out)
    return spark.read.parquet(out).where("kind = 'segment'").drop("kind")


@query(f"""WITH {_CUT.format(tail='session_id % 3 < 2')} SELECT session_id, 'segment' AS kind, seg_idx, start_sample, end_sample, forced FROM s
UNION ALL SELECT e.session_id, CASE e.session_id % 3 WHEN 0 THEN 'stop' ELSE 'idle' END, count(*), NULL, any_value(e.n + 2) * 128, NULL FROM e JOIN s ON s.session_id = e.session_id WHERE e.session_id % 3 < 2 GROUP BY e.session_id""")
def g02_finalize_sessions(spark, sf_dir):
    """Sessions that stop, go idle and abort by turns: whose tails come out, and when each is over."""
    k = F.col("session_id") % 3
    chunks = _ended(spark, sf_dir, F.when(k == 0, "stop").when(k == 2, "abort")).withWatermark("ts", "60 seconds")
    out = files.work_path(spark, "ended-segments")
    st.run_once(st.stream_segments(chunks, idle="120 seconds"), out)
    return spark.read.parquet(out).where("session_id >= 0")


_SHORT = "SELECT user_id AS session_id, event_id, 1 + event_id % 9 AS l, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seg_idx, coalesce(sum(2 + event_id % 9) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM events"


@query(f"""WITH p AS ({_SHORT}), v AS (SELECT *, unnest(CASE WHEN session_id % 2 = 0 THEN range(2, l + 1, 2) ELSE range(2, l + 1, 3) END) AS k FROM p)
SELECT session_id, seg_idx::BIGINT AS seg_idx, (before * 128)::BIGINT AS start_sample, ((before + k) * 128)::BIGINT AS end_sample FROM v""")
def g04_preview_schedule(spark, sf_dir):
    """Previews of open segments, where decodes come back at once (even sessions) or two chunks later (odd ones)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", (1 + F.col("event_id") % 9).cast("int").alias("l"))
    back = lambda i: F.when(F.col("session_id") % 2 == 0, i % 2 == 0).otherwise((i >= 4) & ((i - 4) % 3 == 0))
    said = F.flatten(F.transform(F.sequence(F.lit(1), F.col("l")), lambda i: F.when(back(i), F.array(F.lit("loud"), F.lit("back"))).otherwise(F.array(F.lit("loud")))))
    # of the previews of a segment that closes, those that are still out come back behind it, and then its own decode
    out_there = F.when((F.col("session_id") % 2 == 0) | (F.col("l") < 2), 0).otherwise(F.floor((F.col("l") - 2) / 3) + 1 - F.when(F.col("l") >= 4, F.floor((F.col("l") - 4) / 3) + 1).otherwise(0))
    rows = e.select("session_id", "event_id", F.posexplode(F.concat(said, F.array(F.lit("quiet")), F.array_repeat(F.lit("back"), (out_there + 1).cast("int")))).alias("at", "what"))
    rows = rows.withColumn("chunk_idx", (F.row_number().over(Window.partitionBy("session_id").orderBy("event_id", "at")) - 1).cast("long"))
    wave = lambda x: F.array_repeat(F.lit(x).cast("float"), 128)
    rows = rows.select("session_id", "chunk_idx", F.lit(125).alias("sample_rate"), F.when(F.col("what") == "loud", wave(0.15)).when(F.col("what") == "quiet", wave(0.0005)).alias("samples"), F.lit(False).alias("stop"), F.lit(False).alias("abort"), (F.col("what") == "back").alias("decoded"))
    chunks = _fed(spark, rows.withColumn("step", F.least(F.lit(2), F.floor(F.col("chunk_idx") / 200)).cast("int")), "previews", 3)
    path = files.work_path(spark, "preview-rows")
    st.run_once(st.stream_segments(chunks, preview_ms=st.PREVIEW_MS), path)
    return spark.read.parquet(path).where("kind = 'preview'").select("session_id", "seg_idx", "start_sample", "end_sample")


@query()
def g03_partial_transcripts(spark, sf_dir):
    s = _stream(spark, _turns(spark, sf_dir), "turns")
    out = files.work_path(spark, "partials")
    st.run_each(st.partial_transcripts(s), out)
    return st.partial_texts(spark.read.parquet(out))


@query(f"{_SEAM_SQL} SELECT session_id, segments, text FROM j")
def g03_known_partials(spark, sf_dir):
    """Known cuts as a stream in three micro-batches, some segments before their turn: the last running text is the joined one."""
    t = known_segments(spark, sf_dir)
    i = F.col("seg_idx")
    s = _fed(spark, t.withColumn("step", F.when(i % 7 == 1, F.least(F.lit(2), F.floor(i / 90) + 1)).otherwise(F.least(F.lit(2), F.floor(i / 90))).cast("int")), "known-segments", 3)
    out = files.work_path(spark, "known-partials")
    st.run_each(st.partial_transcripts(s), out)
    return st.partial_texts(spark.read.parquet(out))


_P = "(SELECT user_id AS run_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'confirm' ELSE 'done' END AS stage FROM events)"


@query(f"WITH n AS (SELECT *, lead(ts) OVER w AS nt, lead(stage) OVER w AS ns FROM {_P} WINDOW w AS (PARTITION BY run_id ORDER BY ts)) SELECT run_id, event_id, CASE WHEN nt IS NULL OR epoch_us(nt) - epoch_us(ts) > 3600000000 THEN 'cancelled' WHEN ns = 'confirm' THEN 'declined' ELSE 'answered' END AS outcome FROM n WHERE stage = 'confirm'")
def g05_confirm_timeouts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(F.col("event_id") % 3 == 0, "confirm").otherwise("done").alias("stage"))
    return st.confirm_timeouts(e, 3600).join(e.select("run_id", "ts", "event_id"), ["run_id", "ts"]).select("run_id", "event_id", "outcome")


@query(f"WITH n AS (SELECT *, lead(ts) OVER w AS nt, lead(stage) OVER w AS ns FROM {_P} WINDOW w AS (PARTITION BY run_id ORDER BY ts)), o AS (SELECT run_id, event_id, CASE WHEN nt IS NULL OR epoch_ms(nt) - epoch_ms(ts) > 3600000 THEN 'cancelled' WHEN ns = 'confirm' THEN 'declined' END AS outcome FROM n WHERE stage = 'confirm') SELECT * FROM o WHERE outcome IS NOT NULL")
def g05_stream_confirm_timeouts(spark, sf_dir):
    """The proposals that are not answered, by a stream in four micro-batches with event-time timers."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(i % 3 == 0, "confirm").otherwise("done").alias("stage"))
    last = e.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(-1).cast("long").alias("run_id"), F.lit(-1).cast("long").alias("event_id"), "ts", F.lit("done").alias("stage"), F.lit(3).alias("step"))
    s = _fed(spark, _by_time(e, 4).unionByName(last), "proposals", 4).withWatermark("ts", "10 seconds")
    out = files.work_path(spark, "proposals-out")
    st.run_once(st.stream_confirm_timeouts(s, 3600), out)
    return spark.read.parquet(out).select("run_id", "event_id", "outcome")


_V = "(SELECT user_id AS session_id, ts, event_id, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'result' ELSE 'partial' END AS type FROM events)"


def _voice(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.when(i % 3 == 0, "start").when(i % 3 == 1, "result").otherwise("partial").alias("type"), F.when(i % 3 == 0, "RECORDING").when(i % 3 == 1, "PROCESSING").otherwise("IDLE").alias("state"))


@query(f"WITH v AS (SELECT * FROM {_V}) SELECT s.session_id, s.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(s.ts) <= 7200000000 THEN r.event_id END AS result_id FROM (SELECT * FROM v WHERE type = 'start') s ASOF LEFT JOIN (SELECT * FROM v WHERE type = 'result') r ON s.session_id = r.session_id AND s.ts < r.ts")
def g06_await_results(spark, sf_dir):
    return st.await_results(_voice(spark, sf_dir), 7200)


_LATE = "(type = 'result' AND event_id % 7 = 1 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events))"


@query(f"WITH v AS (SELECT * FROM {_V}) SELECT s.session_id, s.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(s.ts) <= 7200000000 THEN r.event_id END AS result_id FROM (SELECT * FROM v WHERE type = 'start') s ASOF LEFT JOIN (SELECT * FROM v WHERE type = 'result' AND NOT {_LATE}) r ON s.session_id = r.session_id AND s.ts < r.ts")
def g06_stream_await_results(spark, sf_dir):
    """The same as a join of two streams in four micro-batches; some results of the first half come with the last one, too late."""
    v = _by_time(_voice(spark, sf_dir), 4)
    late = (F.col("type") == "result") & (F.col("event_id") % 7 == 1) & (F.col("step") < 2)
    v = v.withColumn("step", F.when(late, 3).otherwise(F.col("step"))).select("session_id", "event_id", "type", "ts", "step")
    last = v.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(-1).cast("long").alias("session_id"), F.lit(-1).cast("long").alias("event_id"), F.explode(F.array(F.lit("start"), F.lit("result"))).alias("type"), "ts", F.lit(3).alias("step"))
    fed = lambda kind: _fed(spark, v.unionByName(last).where(F.col("type") == kind).drop("type"), kind, 4)
    out = files.work_path(spark, "awaited")
    st.run_once(st.stream_await_results(fed("start"), fed("result"), 7200), out)
    return st.first_results(spark.read.parquet(out).where("session_id >= 0"))


@query("SELECT user_id AS session_id, event_id, CASE event_id % 3 WHEN 0 THEN 'RECORDING' WHEN 1 THEN 'PROCESSING' ELSE 'IDLE' END AS state, round((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0, 3) AS seconds FROM events")
def g07_state_intervals(spark, sf_dir):
    return st.state_intervals(_voice(spark, sf_dir)).withColumn("seconds", F.round("seconds", 3))


_G8 = f"SELECT epoch(date_trunc('day', ts))::BIGINT AS start, count(*) FILTER (kind = 'session') AS sessions, count(*) FILTER (kind = 'segment') AS segments, count(*) FILTER (kind = 'seam_repair') AS seam_repairs, count(*) FILTER (kind = 'fallback') AS fallbacks, count(*) FILTER (kind = 'error') AS errors, quantile_disc(ms, 0.5) FILTER (kind = 'stop_to_text') AS typical_ms FROM {_E} GROUP BY 1"


@query(_G8)
def g08_diagnostics_windows(spark, sf_dir):
    return st.stream_diagnostics(diag_events(spark, sf_dir), "1 day").drop("ms_sketch").withColumn("start", F.unix_seconds("start"))


@query(_G8)
def g08_stream_diagnostics(spark, sf_dir):
    """The same, by a stream in complete mode: each micro-batch gives all windows, the last one stands."""
    e = _by_time(diag_events(spark, sf_dir), 3)
    out = files.work_path(spark, "diagnostics-out")
    st.run_each(st.stream_diagnostics(_fed(spark, e, "diagnostics", 3), "1 day").drop("ms_sketch").withColumn("start", F.unix_seconds("start")), out, "complete")
    rows = spark.read.parquet(out)
    return rows.join(rows.agg(F.max("batch_id").alias("batch_id")), "batch_id").drop("batch_id")


_G9 = """WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, (epoch_us(min(ts)) // 1000000)::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k"""


@query(_G9)
def g09_dictation_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return st.stream_dictation_sessions(e, "1 hour").withColumn("start", F.unix_seconds("start"))


@query(_G9)
def g09_stream_dictation_sessions(spark, sf_dir):
    """The same by a stream in append mode, whose sessions go on from one micro-batch to the next; a late last row lets the watermark close them."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts", F.lit(3).alias("step"))
    s = _fed(spark, _by_time(e, 4).unionByName(last), "activity", 4)
    out = files.work_path(spark, "sessions-out")
    st.run_once(st.stream_dictation_sessions(s, "1 hour"), out)
    return spark.read.parquet(out).where("user_id is not null").withColumn("start", F.unix_seconds("start"))


@query()
def g10_stream_postprocess(spark, sf_dir):
    s = _stream(spark, _docs(spark, sf_dir).select("doc_id", "text"), "documents")
    out = files.work_path(spark, "postprocessed")
    st.run_once(st.stream_postprocess(s), out)
    return spark.read.parquet(out)


@query(SPOKEN_ORDERS_SQL)
def g10_known_postprocess(spark, sf_dir):
    """Known spoken sentences as a stream in three micro-batches."""
    t = spoken_orders(spark, sf_dir).withColumn("step", (F.col("o_orderkey") % 3).cast("int"))
    out = files.work_path(spark, "postprocessed-orders")
    st.run_once(st.stream_postprocess(_fed(spark, t, "spoken-orders", 3), spoken=True), out)
    return spark.read.parquet(out)


@query()
def g10_batch_postprocess(spark, sf_dir):
    return postprocess(_docs(spark, sf_dir).select("doc_id", "text"))


def _lines(spark, sf_dir):
    i = F.col("event_id")
    json = F.to_json(F.struct(F.when(i % 2 == 0, "state").otherwise("result").alias("type"), F.col("event_type").alias("text"), i.cast("string").alias("session_id"), (i * 1000).alias("ts")))
    return table(spark, sf_dir, "events").select(F.when(i % 5 == 0, ": ping").when(i % 5 == 1, F.concat(F.lit("data: {bad "), json)).otherwise(F.concat(F.lit("data: "), json)).alias("value"))


_G11 = "SELECT event_id::VARCHAR AS session_id, CASE WHEN event_id % 2 = 0 THEN 'state' ELSE 'result' END AS type, event_type AS text, event_id AS at FROM events WHERE event_id % 5 > 1"


@query(_G11)
def g11_event_lines(spark, sf_dir):
    path = files.work_path(spark, "lines")
    _lines(spark, sf_dir).write.text(path)
    return files.read_event_lines(spark, path).select("session_id", "type", "text", F.unix_seconds("ts").alias("at"))


@query(_G11)
def h05_event_log_stream(spark, sf_dir):
    """The lines as a stream of text files in three micro-batches; each batch is written twice, as after a failure."""
    path, out = files.work_path(spark, "line-log"), files.work_path(spark, "event-log")
    lines = _lines(spark, sf_dir).withColumn("step", F.pmod(F.xxhash64("value"), F.lit(3)))
    for k in range(3):
        lines.where(F.col("step") == k).select("value").repartition(_FILES).write.mode("append").text(path)
    stream = files.stream_event_lines(spark, path, max_files=_FILES)

    def twice(to):
        write = st.write_batch(to)
        return lambda batch, i: (write(batch, i), write(batch, i))

    st.run_each(stream, out, "append", twice)
    return spark.read.parquet(out).select("session_id", "type", "text", F.unix_seconds("ts").alias("at"))


@query("SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, event_id % 7 AS audio_ms, event_id AS at FROM events")
def h01_history_json(spark, sf_dir):
    path = files.work_path(spark, "history")
    i = F.col("event_id")
    table(spark, sf_dir, "events").select(i.cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), (i * 1000).alias("timestamp"), (i % 7).alias("audioMs")).write.json(path)
    return files.read_history(spark, path, multi_line=False).select("id", "user_id", "audio_ms", F.unix_seconds("ts").alias("at"))


@query("SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, event_id % 7 AS audio_ms, event_id AS at FROM events")
def h01_history_arrays(spark, sf_dir):
    """Files of one JSON array each, over many lines, as the app writes them."""
    path, i = files.work_path(spark, "history-arrays"), F.col("event_id")
    entry = F.struct(i.cast("string").alias("id"), F.col("user_id").cast("string").alias("user_id"), (i * 1000).alias("timestamp"), (i % 7).alias("audioMs"))
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.replace(F.to_json(F.collect_list(entry)), F.lit("},{"), F.lit("},\n  {")).alias("value"))
    a.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_history(spark, path).select("id", "user_id", "audio_ms", F.unix_seconds("ts").alias("at"))


@query("SELECT DISTINCT p_brand AS id, 2::INTEGER AS n_patterns, 2::INTEGER AS n_steps FROM part")
def h02_recipe_pack(spark, sf_dir):
    from .command_queries import recipes

    path = files.work_path(spark, "recipes")
    recipes(spark, sf_dir).write.json(path)
    return files.read_recipes(spark, path, multi_line=False).select("id", F.size("patterns").alias("n_patterns"), F.size("steps").alias("n_steps"))


@query("SELECT DISTINCT p_brand AS id, 2::INTEGER AS n_patterns, 2::INTEGER AS n_steps FROM part")
def h02_recipe_arrays(spark, sf_dir):
    from .command_queries import recipes

    path = files.work_path(spark, "recipe-arrays")
    r = recipes(spark, sf_dir)
    packs = r.groupBy(F.substring("id", -1, 1).alias("pack")).agg(F.replace(F.to_json(F.collect_list(F.struct(*r.columns))), F.lit(",{"), F.lit(",\n{")).alias("value"))
    packs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_recipes(spark, path).select("id", F.size("patterns").alias("n_patterns"), F.size("steps").alias("n_steps"))


@query("SELECT DISTINCT p_brand AS brand, replace(p_brand, '#', '-') AS said, 'room 23' AS room, 42::BIGINT AS number FROM part")
def i02_register_sql(spark, sf_dir):
    """The helpers by name, in SQL."""
    from ..functions.sql import register_sql

    register_sql(spark)
    table(spark, sf_dir, "part").select("p_brand").distinct().createOrReplaceTempView("vox_brands")
    return spark.sql("SELECT p_brand AS brand, spoken_punctuation(replace(p_brand, '#', ' hyphen ')) AS said, apply_itn(concat('room', ' twenty three')) AS room, number_words_to_int('forty two') AS number FROM vox_brands")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Play ' || p_name || ' on ' || p_brand || '!' END AS filled, (p_partkey % 90 + 10)::BIGINT AS number, 'room ' || (p_partkey % 90 + 10) AS room FROM part""")
def i02_sql_on_columns(spark, sf_dir):
    """The helpers in SQL over columns of a table."""
    from ..functions.sql import register_sql
    from . import spoken_forms

    register_sql(spark)
    k = F.col("p_partkey")
    said = F.concat(F.when(k % 2 == 0, "play ").otherwise("stop "), "p_name", F.lit("  on "), "p_brand", F.lit("."))
    table(spark, sf_dir, "part").select("p_partkey", said.alias("said"), spoken_forms.words(k % 90 + 10).alias("n")).createOrReplaceTempView("vox_said")
    return spark.sql("SELECT p_partkey, fill_slots('Play {{what}} on {{place}}{{nobody}}!', pattern_slots(said, 'Play {what} on {place}')) AS filled, number_words_to_int(n) AS number, apply_itn(concat('room ', n)) AS room FROM vox_said")
