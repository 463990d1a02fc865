"""Decode health, diagnostics and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_stats(steps: DataFrame, segment: str = "segment_id", reset_every: int = 15) -> DataFrame:
    """From step rows (segment, step, frame, token or null): last token frame, blank ratio, longest blank run, resets."""
    w = Window.partitionBy(segment).orderBy("step")
    blank = F.col("token").isNull()
    t = steps.withColumn("grp", F.sum((~blank).cast("int")).over(w))
    runs = t.where(blank).groupBy(segment, "grp").agg(F.count("*").alias("run"))
    r = runs.groupBy(segment).agg(F.least(F.max("run"), F.lit(reset_every)).alias("max_blank_run"), F.sum(F.floor(F.col("run") / reset_every)).alias("resets"))
    base = steps.groupBy(segment).agg(F.max(F.when(~blank, F.col("frame"))).alias("last_token_frame"), F.avg(blank.cast("double")).alias("blank_ratio"), F.count("*").alias("steps"))
    return base.join(r, segment, "left").select(segment, F.coalesce("last_token_frame", F.lit(0)).alias("last_token_frame"), "blank_ratio", "steps", F.coalesce("max_blank_run", F.lit(0)).cast("long").alias("max_blank_run"), F.coalesce("resets", F.lit(0)).cast("long").alias("resets"))


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def assess_decode(df: DataFrame) -> DataFrame:
    """degraded and reason, from last_token_frame, total_frames, collapse_recoveries, blank_ratio."""
    total, n = F.col("total_frames"), F.col("collapse_recoveries")
    tail = F.when(total > 0, F.greatest(F.lit(0), total - F.col("last_token_frame")) / total).otherwise(0.0)
    collapsed = (total >= 25) & (n > 0) & (tail >= 0.2)
    blank = (total >= 25) & ~collapsed & (F.col("blank_ratio") >= 0.8)
    why = F.concat(F.lit("decoder collapsed ("), n.cast("string"), F.when(n > 1, " resets").otherwise(" reset"), F.lit(") and never recovered — "), percent(tail), F.lit(" of the segment produced no tokens"))
    return df.withColumns({"degraded": collapsed | blank, "reason": F.when(collapsed, why).when(blank, F.concat(percent(F.col("blank_ratio")), F.lit(" of decode steps emitted blank"))).otherwise("")})


def prefer_better_decode(df: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Of the attempts at a segment the one that reached furthest, then the longest text, then the first."""
    w = Window.partitionBy(segment).orderBy(F.desc("last_token_frame"), F.desc(F.length("text")), "attempt")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flag_truncated(df: DataFrame) -> DataFrame:
    return df.where((F.col("last_token_frame") / F.col("total_frames") < 0.85) & (F.col("audio_s") > 10))


def fixed1(x: Column) -> Column:
    """One decimal, from the double's exact value: halves exist only where the tenth is exact."""
    return F.format_string("%.1f", F.round(x.cast("decimal(38,18)"), 1).cast("double"))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def speed_factor(audio_ms: Column, latency_ms: Column) -> Column:
    return F.when((audio_ms > 0) & (latency_ms > 0), audio_ms / latency_ms)


def format_audio_length(ms: Column) -> Column:
    s = ms / 1000
    return F.when(s < 60, F.concat(fixed1(s), F.lit("s"))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(_half_up(s - 60 * F.floor(s / 60)).cast("string"), 2, "0")))


def format_latency(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(_half_up(ms).cast("string"), F.lit("ms"))).otherwise(F.concat(fixed1(ms / 1000), F.lit("s")))


def format_speed(audio_ms: Column, latency_ms: Column) -> Column:
    x = speed_factor(audio_ms, latency_ms)
    return F.when(x >= 10, F.concat(_half_up(x).cast("string"), F.lit("×"))).when(x.isNotNull(), F.concat(fixed1(x), F.lit("×")))


def nearest_rank(col: str, p: float) -> Column:
    """The smallest value with at least that share of all at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})")


#: Size of a sketch: ranks are off by about 1.7 / k ** 0.9 of all (99 % of cases), 0.1 % here; up to some thousand values it is exact.
SKETCH_K, SKETCH_ERROR = 4096, 0.001


def latency_sketch(c: str | Column, k: int = SKETCH_K) -> Column:
    """An aggregate of a bounded size, of a group or time window, from which percentiles can be had later."""
    return F.kll_sketch_agg_bigint(c, k)


def merge_sketches(c: str | Column, k: int = SKETCH_K) -> Column:
    """An aggregate: the sketch of all values behind the sketches, as of windows that make up a longer time."""
    return F.kll_merge_agg_bigint(c, k)


def sketch_percentile(sketch: str | Column, p: float) -> Column:
    """The nearest-rank percentile of a sketch, within its rank error; null of no values."""
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_bigint(s) > 0, F.kll_sketch_get_quantile_bigint(s, F.lit(p)))


def latency_report(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By length of audio, and over all (bucket "all"): n, typical wait and best speed."""
    b = F.when(F.col("audio_ms") < 10_000, "<10s").when(F.col("audio_ms") < 30_000, "10-30s").when(F.col("audio_ms") < 60_000, "30-60s").otherwise(">60s")
    h = history.withColumns({"bucket": b, "speed": speed_factor(F.col("audio_ms"), F.col("latency_ms"))}).where("speed is not null")
    g = h.rollup("bucket") if not by else h.groupBy(*by, "bucket")
    return g.agg(F.count("*").alias("n"), nearest_rank("latency_ms", 0.5).cast("long").alias("typical_ms"), F.max("speed").alias("best")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def diagnostics_summary(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters, rates to three decimals and nearest-rank percentiles of kind-tagged events."""
    is_ = lambda k: F.sum((F.col("kind") == k).cast("long"))
    ms = lambda k, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN kind = '{k}' THEN ms END)")
    g = events.groupBy(*(by or []))
    t = g.agg(is_("session").alias("sessions"), is_("segment").alias("segments"), is_("seam_repair").alias("seam_repairs"), is_("restart").alias("restarts_trimmed"), is_("fallback").alias("fallbacks"), is_("error").alias("errors"),
              F.sum(((F.col("kind") == "segment") & F.col("forced")).cast("long")).alias("forced_splits"), *(F.coalesce(ms("stop_to_text", p / 100), F.lit(0)).cast("long").alias(f"stop_p{p}") for p in (50, 90, 99)))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 3)).otherwise(0.0)
    seams = F.greatest(F.col("segments") - F.col("sessions"), F.lit(0))
    return t.withColumns({"segments_per_session": rate(F.col("segments"), F.col("sessions")), "seam_repair_rate": rate(F.col("seam_repairs"), seams), "fallback_rate": rate(F.col("fallbacks"), F.col("sessions"))})


def recent_sample(df: DataFrame, metric: str = "kind", ts: str = "ts", n: int = 500) -> DataFrame:
    return _newest(df, metric, [ts], n)


def _newest(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def capture_verdict(ms: Column) -> Column:
    return F.when(ms <= 0, None).when(ms <= 100, "good").when(ms <= 250, "noticeable").when(ms > 250, "HIGH")


def paste_reason_report(history: DataFrame) -> DataFrame:
    t = history.where("paste_reason is not null").groupBy("paste_reason").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def cap_history(history: DataFrame, n: int = 200, user: str = "user_id") -> DataFrame:
    """Each user's newest entries (row_number below a limit is cut per partition before the shuffle)."""
    return _newest(history, user, ["ts", "id"], n)


def recent_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(min(200, max(1, limit if limit is not None else 20)))


def spoken_history(history: DataFrame, limit: int | None = None) -> DataFrame:
    n = min(10, max(1, limit if limit is not None else 3))
    return cap_history(history, n).withColumn("preview", F.when(F.length("text") > 90, F.concat(F.substring("text", 1, 90), F.lit("…"))).otherwise(F.col("text")))


def delete_history(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id"), "id", "left_anti")


def flag_double_entries(history: DataFrame, within_ms: int = 2000) -> DataFrame:
    """Entries that repeat the text just before them with another capture latency: linear, by lag."""
    w = Window.partitionBy("user_id", "text").orderBy("ts", "id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1000
    return history.withColumn("doubled", F.coalesce((gap <= within_ms) & (F.col("capture_latency_ms") != F.lag("capture_latency_ms").over(w)), F.lit(False)))


def preview_affordable(df: DataFrame, warm: str = "warm_ms") -> DataFrame:
    m = F.col(warm)
    return df.withColumns({"affordable": F.coalesce(m <= 300, F.lit(False)), "interval_ms": F.when(m <= 100, 700).when(m <= 300, 1200)})
