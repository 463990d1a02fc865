"""Queries of decode health, diagnostics and history, over events and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decode as d
from .registry import query
from .text_queries import table

_H = """(SELECT event_id::VARCHAR AS id, user_id, 'text ' || (event_id % 40) AS text, ts, event_type AS app, event_id % 90000 + 1 AS audio_ms, event_id * 37 % 1900 AS latency_ms, event_id * 13 % 400 - 20 AS capture_latency_ms,
CASE WHEN event_id % 5 = 0 THEN event_type END AS paste_reason FROM events)"""


def _history(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.cast("string").alias("id"), "user_id", F.concat(F.lit("text "), (i % 40).cast("string")).alias("text"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("app"), (i % 90000 + 1).alias("audio_ms"),
                                                 (i * 37 % 1900).alias("latency_ms"), (i * 13 % 400 - 20).alias("capture_latency_ms"), F.when(i % 5 == 0, F.col("event_type")).alias("paste_reason"))


_KINDS = ["session", "segment", "segment", "seam_repair", "restart", "fallback", "error", "stop_to_text", "stop_to_text", "segment_decode"]
_E = f"(SELECT event_id, user_id, ts, list_extract([{', '.join(repr(k) for k in _KINDS)}], (event_id % 10 + 1)::INT) AS kind, event_id % 3 = 0 AS forced, event_id * 7 % 991 AS ms FROM events)"


def events(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.element_at(F.array(*map(F.lit, _KINDS)), (i % 10 + 1).cast("int")).alias("kind"), (i % 3 == 0).alias("forced"), (i * 7 % 991).alias("ms"))


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS step, CASE WHEN l_partkey % 4 = 0 THEN l_partkey END AS token FROM lineitem),
g AS (SELECT *, count(token) OVER (PARTITION BY l_orderkey ORDER BY step) AS grp FROM s),
r AS (SELECT l_orderkey, grp, count(*) AS run FROM g WHERE token IS NULL GROUP BY ALL),
x AS (SELECT l_orderkey, least(max(run), 3) AS m, sum(run // 3) AS resets FROM r GROUP BY l_orderkey)
SELECT s.l_orderkey AS segment_id, coalesce(max(step * 2) FILTER (token IS NOT NULL), 0)::BIGINT AS last_token_frame, round(avg((token IS NULL)::INT::DOUBLE), 6) AS blank_ratio, count(*) AS steps, coalesce(max(m), 0)::BIGINT AS max_blank_run, coalesce(max(resets), 0)::BIGINT AS resets
FROM s LEFT JOIN x ON x.l_orderkey = s.l_orderkey GROUP BY s.l_orderkey""")
def d01_decode_stats(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.row_number().over(w).cast("long").alias("step"), F.when(F.col("l_partkey") % 4 == 0, F.col("l_partkey")).alias("token"))
    return d.decode_stats(s.withColumn("frame", F.col("step") * 2), reset_every=3).withColumn("blank_ratio", F.round("blank_ratio", 6))


_DEC = "(SELECT o_orderkey AS k, o_orderkey % 100 AS total, o_orderkey * 31 % 100 AS last, o_orderkey % 3 AS n, (o_orderkey * 17 % 100) / 100.0::DOUBLE AS blank FROM orders)"


def _decodes(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("segment_id"), (k % 100).alias("total_frames"), (k * 31 % 100).alias("last_token_frame"), (k % 3).alias("collapse_recoveries"), ((k * 17 % 100) / 100.0).alias("blank_ratio"), (k % 40).cast("double").alias("audio_s"))


@query(f"""WITH t AS (SELECT *, CASE WHEN total > 0 THEN greatest(0, total - last) / total::DOUBLE ELSE 0 END AS tail FROM {_DEC}),
c AS (SELECT *, total >= 25 AND n > 0 AND tail >= 0.2 AS col, total >= 25 AND blank >= 0.8 AS bl FROM t)
SELECT k AS segment_id, col OR bl AS degraded, CASE WHEN col THEN 'decoder collapsed (' || n || CASE WHEN n > 1 THEN ' resets' ELSE ' reset' END || ') and never recovered — ' || floor(tail * 100 + 0.5)::INT || '% of the segment produced no tokens' WHEN bl THEN floor(blank * 100 + 0.5)::INT || '% of decode steps emitted blank' ELSE '' END AS reason FROM c""")
def d02_assess_decode(spark, sf_dir):
    return d.assess_decode(_decodes(spark, sf_dir)).select("segment_id", "degraded", "reason")


@query("SELECT l_orderkey AS segment_id, l_linenumber AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 5 DESC, l_suppkey % 7 DESC, l_linenumber) AS r FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) WHERE r = 1")
def d03_prefer_better_decode(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))  # noqa: E741
    a = l.select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("attempt"), (F.col("x.l_partkey") % 5).alias("last_token_frame"), F.call_function("repeat", F.lit("x"), (F.col("x.l_suppkey") % 7).cast("int")).alias("text"))
    return d.prefer_better_decode(a).select("segment_id", "attempt")


@query(f"SELECT k AS segment_id FROM {_DEC} WHERE total > 0 AND last / total::DOUBLE < 0.85 AND k % 40 > 10")
def d04_flag_truncated(spark, sf_dir):
    return d.flag_truncated(_decodes(spark, sf_dir).where("total_frames > 0")).select("segment_id")


_F1 = "printf('%.1f', round({}::DECIMAL(38,18), 1)::DOUBLE)"


@query(f"""SELECT id, CASE WHEN audio_ms < 60000 THEN {_F1.format('audio_ms / 1000.0::DOUBLE')} || 's' ELSE (audio_ms // 60000) || ':' || lpad(floor(audio_ms / 1000.0 - 60 * (audio_ms // 60000) + 0.5)::INT::VARCHAR, 2, '0') END AS audio,
CASE WHEN latency_ms < 1000 THEN latency_ms || 'ms' ELSE {_F1.format('latency_ms / 1000.0::DOUBLE')} || 's' END AS latency,
CASE WHEN latency_ms <= 0 THEN NULL WHEN audio_ms / latency_ms::DOUBLE >= 10 THEN floor(audio_ms / latency_ms::DOUBLE + 0.5)::INT || '×' ELSE {_F1.format('audio_ms / latency_ms::DOUBLE')} || '×' END AS speed FROM {_H}""")
def d05_formats(spark, sf_dir):
    a, l = F.col("audio_ms"), F.col("latency_ms")  # noqa: E741
    return _history(spark, sf_dir).select("id", d.format_audio_length(a).alias("audio"), d.format_latency(l).alias("latency"), d.format_speed(a, l).alias("speed"))


@query(f"""WITH h AS (SELECT *, CASE WHEN audio_ms < 10000 THEN '<10s' WHEN audio_ms < 30000 THEN '10-30s' WHEN audio_ms < 60000 THEN '30-60s' ELSE '>60s' END AS bucket FROM {_H} WHERE latency_ms > 0)
SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, quantile_disc(latency_ms, 0.5) AS typical_ms, round(max(audio_ms / latency_ms::DOUBLE), 6) AS best FROM h GROUP BY ROLLUP (bucket)""")
def d06_latency_report(spark, sf_dir):
    return d.latency_report(_history(spark, sf_dir)).withColumn("best", F.round("best", 6))


@query(f"""WITH c AS (SELECT user_id % 10 AS grp, count(*) FILTER (kind = 'session') AS sessions, count(*) FILTER (kind = 'segment') AS segments, count(*) FILTER (kind = 'seam_repair') AS seam_repairs, count(*) FILTER (kind = 'restart') AS restarts_trimmed, count(*) FILTER (kind = 'fallback') AS fallbacks, count(*) FILTER (kind = 'error') AS errors,
count(*) FILTER (kind = 'segment' AND forced) AS forced_splits, {', '.join(f"coalesce(quantile_disc(ms, {p / 100}) FILTER (kind = 'stop_to_text'), 0) AS stop_p{p}" for p in (50, 90, 99))} FROM {_E} GROUP BY 1)
SELECT *, CASE WHEN sessions > 0 THEN round(segments / sessions::DOUBLE, 3) ELSE 0 END AS segments_per_session, CASE WHEN segments > sessions THEN round(seam_repairs / (segments - sessions)::DOUBLE, 3) ELSE 0 END AS seam_repair_rate, CASE WHEN sessions > 0 THEN round(fallbacks / sessions::DOUBLE, 3) ELSE 0 END AS fallback_rate FROM c""")
def d07_diagnostics_summary(spark, sf_dir):
    return d.diagnostics_summary(events(spark, sf_dir).withColumn("grp", F.col("user_id") % 10), ["grp"])


@query("SELECT user_id, quantile_disc(event_id, 0.9) AS p90 FROM events GROUP BY user_id")
def d08_nearest_rank_percentile(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(d.nearest_rank("event_id", 0.9).cast("long").alias("p90"))


@query(f"SELECT user_id % 10 AS grp, p, count(ms) AS n, quantile_disc(ms, 0.5) FILTER (p = 0.5) AS exact_p50, true AS within FROM {_E}, (SELECT unnest([0.5, 0.9, 0.99]) AS p) GROUP BY 1, 2")
def d08_sketch_percentile(spark, sf_dir):
    """Percentiles of sketches of days, merged: the share of values up to each is within the stated error of its rank."""
    e = events(spark, sf_dir).select((F.col("user_id") % 10).alias("grp"), F.to_date("ts").alias("day"), F.col("ms").cast("long").alias("ms"))
    days = e.groupBy("grp", "day").agg(d.latency_sketch("ms").alias("s"))
    whole = days.groupBy("grp").agg(d.merge_sketches("s").alias("s"))
    at = whole.select("grp", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), d.sketch_percentile("s", p).alias("v")) for p in (0.5, 0.9, 0.99)))).alias("x")).select("grp", "x.*")
    ranks = e.join(F.broadcast(at), "grp").groupBy("grp", "p", "v").agg(F.count("*").alias("n"), F.avg((F.col("ms") <= F.col("v")).cast("double")).alias("upto"), F.avg((F.col("ms") < F.col("v")).cast("double")).alias("below"))
    within = (F.col("below") <= F.col("p") + d.SKETCH_ERROR) & (F.col("upto") >= F.col("p") - d.SKETCH_ERROR)
    exact = e.groupBy("grp").agg(d.nearest_rank("ms", 0.5).cast("long").alias("exact_p50"))
    return ranks.join(exact, "grp").select("grp", "p", "n", F.when(F.col("p") == 0.5, F.col("exact_p50")).alias("exact_p50"), within.alias("within"))


@query(f"SELECT event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC) AS r FROM (SELECT event_id, kind, epoch_us(ts) // 1000000 * 1000000 + event_id AS ts FROM {_E})) WHERE r <= 500")
def d09_recent_sample(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "kind", (F.unix_seconds("ts") * 1000000 + F.col("event_id")).alias("ts"))
    return d.recent_sample(e).select("event_id", "kind")


@query(f"SELECT id, CASE WHEN capture_latency_ms <= 0 THEN NULL WHEN capture_latency_ms <= 100 THEN 'good' WHEN capture_latency_ms <= 250 THEN 'noticeable' ELSE 'HIGH' END AS verdict FROM {_H}")
def d10_capture_verdict(spark, sf_dir):
    return _history(spark, sf_dir).select("id", d.capture_verdict(F.col("capture_latency_ms")).alias("verdict"))


@query(f"SELECT paste_reason, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share FROM {_H} WHERE paste_reason IS NOT NULL GROUP BY 1")
def d11_paste_reason_report(spark, sf_dir):
    return d.paste_reason_report(_history(spark, sf_dir))


@query(f"SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM {_H}) WHERE r <= 50")
def d12_cap_history(spark, sf_dir):
    return d.cap_history(_history(spark, sf_dir), 50).select("id", "user_id")


@query(f"SELECT id, ts::VARCHAR[:19] AS at FROM {_H} ORDER BY ts DESC, id DESC LIMIT 200".replace("ts::VARCHAR[:19]", "strftime(ts, '%Y-%m-%d %H:%M:%S')"))
def d13_recent_history(spark, sf_dir):
    return d.recent_history(_history(spark, sf_dir), 1000).select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(f"SELECT id, user_id FROM {_H} WHERE id::BIGINT % 7 <> 0")
def d14_delete_history(spark, sf_dir):
    h = _history(spark, sf_dir)
    return d.delete_history(h, h.where(F.col("id").cast("long") % 7 == 0)).select("id", "user_id")


@query(f"SELECT id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000.0 <= 600000000 AND capture_latency_ms <> lag(capture_latency_ms) OVER w, false) AS doubled FROM {_H} WINDOW w AS (PARTITION BY user_id, text ORDER BY ts, id)")
def d15_flag_double_entries(spark, sf_dir):
    return d.flag_double_entries(_history(spark, sf_dir), within_ms=600_000_000).select("id", "doubled")


@query("SELECT event_id, coalesce(w <= 300, false) AS affordable, CASE WHEN w <= 100 THEN 700 WHEN w <= 300 THEN 1200 END AS interval_ms FROM (SELECT event_id, CASE WHEN event_id % 11 > 0 THEN event_id % 500 END AS w FROM events)")
def d16_preview_affordable(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 > 0, F.col("event_id") % 500).alias("warm_ms"))
    return d.preview_affordable(e).select("event_id", "affordable", "interval_ms")
