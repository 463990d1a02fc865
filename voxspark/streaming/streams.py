"""Structured Streaming forms of the dictation jobs; most also take a batch DataFrame."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.decode import latency_sketch, sketch_percentile
from .processors import PARTIAL, PARTIAL_STATE, PROPOSAL, SEGMENT, SEGMENT_STATE, PartialProcessor, ProposalProcessor, SegmentProcessor, group_handler

PREVIEW_MS = 1200


def stream_segments(chunks: DataFrame, idle: str | None = None, preview_ms: int | None = None) -> DataFrame:
    """Closed segments of a stream of (session_id, chunk_idx, sample_rate, samples, stop, abort).

    Chunks that come too early wait until their number is due.  A stop row closes the tail, an
    abort row drops all that is open; with idle (an interval; the stream needs a watermark on ts) silence of the source does.
    preview_ms: also rows of kind "preview" where a preview of the open segment is due; with a
    column decoded (rows that say a decode of a preview or segment has come back) none is due while one is in flight.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    run = group_handler(SegmentProcessor(idle_ms, preview_ms), ["record", "windows", "early"])
    return chunks.groupBy("session_id").applyInPandasWithState(run, SEGMENT, SEGMENT_STATE, "append", "EventTimeTimeout" if idle else "NoTimeout")


def partial_transcripts(segments: DataFrame, ttl: str | None = None) -> DataFrame:
    """After every batch of segments (session_id, seg_idx from 0, text, forced_split): newly settled text, and the end as it stands.

    ttl: an interval after whose passing without a segment a session's state goes.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    run = group_handler(PartialProcessor(ttl_ms), ["fold", "early"], ttl_ms)
    return segments.groupBy("session_id").applyInPandasWithState(run, PARTIAL, PARTIAL_STATE, "update", "ProcessingTimeTimeout" if ttl else "NoTimeout")


def partial_texts(partials: DataFrame) -> DataFrame:
    """Rows of partial_transcripts that were written down, to the last text of each session: session_id, segments, text."""
    w = Window.partitionBy("session_id")
    rows = partials.withColumn("last", F.max("segments").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segments", "settled"))), lambda p: p["settled"]), "")
    tail = F.max(F.when(F.col("segments") == F.col("last"), F.col("tail")))
    return rows.groupBy("session_id").agg(F.max("segments").alias("segments"), F.trim(F.concat(text, tail)).alias("text"))


def stream_confirm_timeouts(events: DataFrame, seconds: int = 15) -> DataFrame:
    """Stream of (run_id, event_id, ts, stage) with a watermark on ts: unanswered proposals, and those a newer one replaced."""
    return events.groupBy("run_id").transformWithStateInPandas(ProposalProcessor(seconds), PROPOSAL, "append", "eventTime")


def confirm_timeouts(events: DataFrame, seconds: int = 15) -> DataFrame:
    """The batch twin: run_id, ts of proposals and what became of them."""
    w = Window.partitionBy("run_id").orderBy("ts")
    t = events.withColumns({"next_ts": F.lead("ts").over(w), "next": F.lead("stage").over(w)}).where("stage = 'confirm'")
    gap = F.unix_micros("next_ts") - F.unix_micros("ts")
    late = F.col("next_ts").isNull() | (gap > seconds * 1_000_000)
    return t.select("run_id", "ts", F.when(late, "cancelled").when(F.col("next") == "confirm", "declined").otherwise("answered").alias("outcome"))


def await_results(events: DataFrame, timeout_s: int = 120, key: str = "session_id") -> DataFrame:
    """For each start (type "start") the first later result of its key, or null after the timeout."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    r = F.when(F.col("type") == "result", F.struct("ts", "event_id"))
    t = events.withColumn("r", F.first(r, ignorenulls=True).over(w)).where("type = 'start'")
    ok = F.unix_micros("r.ts") - F.unix_micros("ts") <= timeout_s * 1_000_000
    return t.select(key, "event_id", F.when(ok, F.col("r.event_id")).alias("result_id"))


def stream_await_results(starts: DataFrame, results: DataFrame, timeout_s: int = 120, late: str = "10 seconds", key: str = "session_id") -> DataFrame:
    """Watermarked interval join of two streams of (key, event_id, ts): every result of a start in time.

    A start without one comes out with nulls when its time is over; rows that are later than the watermark are dropped.
    """
    s = starts.withWatermark("ts", late).alias("s")
    r = results.withWatermark("ts", late).alias("r")
    cond = (F.col(f"s.{key}") == F.col(f"r.{key}")) & (F.col("r.ts") > F.col("s.ts")) & (F.col("r.ts") <= F.col("s.ts") + F.expr(f"interval {timeout_s} seconds"))
    return s.join(r, cond, "leftOuter").select(F.col(f"s.{key}").alias(key), F.col("s.event_id").alias("event_id"), F.col("s.ts").alias("started"), F.col("r.ts").alias("ended"), F.col("r.event_id").alias("result_id"))


def first_results(joined: DataFrame, key: str = "session_id") -> DataFrame:
    """Of what stream_await_results has written: each start with its first result, or null."""
    first = F.min(F.when(F.col("ended").isNotNull(), F.struct("ended", "result_id")))
    return joined.groupBy(key, "event_id").agg(first.alias("f")).select(key, "event_id", F.col("f.result_id").alias("result_id"))


def state_intervals(events: DataFrame, key: str = "session_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("until", F.lead("ts").over(w)).select(key, "event_id", "state", ((F.unix_micros("until") - F.unix_micros("ts")) / 1_000_000).alias("seconds"))


def stream_diagnostics(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counters of kinds per window, and a sketch of latencies with the typical one; late rows beyond the watermark are dropped in a stream.

    The sketch is what a stream holds of a window's latencies; those of several windows can be merged (operators.decode).
    """
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window))
    return g.agg(n("session").alias("sessions"), n("segment").alias("segments"), n("seam_repair").alias("seam_repairs"), n("fallback").alias("fallbacks"), n("error").alias("errors"), latency_sketch(F.when(F.col("kind") == "stop_to_text", F.col("ms"))).alias("ms_sketch")).select(F.col("window.start").alias("start"), "sessions", "segments", "seam_repairs", "fallbacks", "errors", sketch_percentile("ms_sketch", 0.5).alias("typical_ms"), "ms_sketch")


def stream_dictation_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def stream_postprocess(df: DataFrame, **options) -> DataFrame:
    """postprocess() is stateless, so a stream takes it as it is; a dictionary is fixed per query."""
    from ..functions.pipeline import postprocess

    return postprocess(df, **options)


@contextmanager
def _state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which stateful processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_once(df: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over what is there, to Parquet files at path."""
    with _state_store(df.sparkSession):
        q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def write_batch(path: str):
    """A foreachBatch sink: each batch in a folder of its own number, so that one that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_each(df: DataFrame, path: str, mode: str = "update", sink=write_batch) -> None:
    """The same for update and complete mode, by way of foreachBatch; the rows have the column batch_id."""
    with _state_store(df.sparkSession):
        q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(sink(path)).trigger(availableNow=True).start()
    q.awaitTermination()
