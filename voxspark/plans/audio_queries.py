"""Queries of the audio operators, over embeddings as short signals and events as energy series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import audio as a
from .registry import query
from .text_queries import table


def _clips(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").cast("array<float>").alias("samples"))


def _sessions(spark, sf_dir):
    """Ten vectors a session, one a chunk."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("session_id"), (F.col("vec_id") % 10).alias("chunk_idx"), F.col("embedding").cast("array<float>").alias("samples"), F.lit(1000).alias("sample_rate"))


def _lengths(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), (F.col("o_orderkey") * 104729 % 3000000 + 1).alias("n_samples"))


_LEN = "(SELECT o_orderkey AS clip_id, o_orderkey * 104729 % 3000000 + 1 AS n FROM orders)"
_X = "(SELECT vec_id // 10 AS session_id, (vec_id % 10) * 64 + i - 1 AS p, embedding[i]::FLOAT::DOUBLE AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"
_WIN = f"(SELECT session_id, p // 48 AS win_idx, sqrt(sum(x * x) / 48) AS rms FROM {_X} GROUP BY 1, 2 HAVING count(*) = 48)"


def _weighed(c):
    """One number that depends on each sample and its place."""
    return F.round(F.aggregate(F.transform(c, lambda x, i: (i + 1) * x.cast("double")), F.lit(0.0), lambda s, x: s + x), 3)


@query("""WITH c AS (SELECT vec_id // 100 AS c, count(*) * 64 AS n, min(vec_id) AS a, max(vec_id) AS z, sum(list_sum(list_transform(embedding, lambda x: x::FLOAT::DOUBLE))) AS total FROM embeddings GROUP BY 1)
SELECT 'clip' || c || '-' || c * 1000 || '-16000hz' AS clip_id, c * 1000 AS ms, 16000 AS sample_rate, n, round(f.embedding[1]::FLOAT::DOUBLE, 5) AS first, round(l.embedding[64]::FLOAT::DOUBLE, 5) AS last, round(total, 3) AS total
FROM c JOIN embeddings f ON f.vec_id = a JOIN embeddings l ON l.vec_id = z""")
def c01_read_f32_audio(spark, sf_dir):
    """A hundred vectors a dump, written and read back."""
    from ..sources.files import read_f32_audio, work_path, write_f32_audio

    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("c")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<float>").alias("e")))).alias("v"))
    dumps = rows.select(F.concat(F.lit("clip"), "c").alias("clip_id"), (F.col("c") * 1000).alias("ms"), F.lit(16000).alias("sample_rate"), F.flatten(F.transform("v", lambda x: x["e"])).alias("samples"))
    path = work_path(spark, "audio")
    write_f32_audio(dumps, path)
    s = F.transform("samples", lambda x: x.cast("double"))
    return read_f32_audio(spark, f"{path}/*.f32").select("clip_id", F.unix_millis("ts").alias("ms"), "sample_rate", F.size("samples").cast("long").alias("n"), F.round(F.get(s, F.lit(0)), 5).alias("first"), F.round(F.element_at(s, -1), 5).alias("last"),
                                                         F.round(F.aggregate(s, F.lit(0.0), lambda x, y: x + y), 3).alias("total"))


@query("SELECT vec_id AS clip_id, 32 AS n, round(embedding[1]::FLOAT::DOUBLE, 5) AS first, round(list_sum(list_transform(range(0, 32), lambda i: (i + 1) * embedding[2 * i + 1]::FLOAT::DOUBLE)), 3) AS weighed FROM embeddings")
def c02_resample_cubic(spark, sf_dir):
    """To half the rate: every second sample."""
    r = _clips(spark, sf_dir).select("clip_id", a.resample_cubic(F.col("samples"), F.lit(32000)).alias("s"))
    return r.select("clip_id", F.size("s").alias("n"), F.round(F.get("s", F.lit(0)).cast("double"), 5).alias("first"), _weighed("s").alias("weighed"))


@query("SELECT vec_id AS clip_id FROM embeddings WHERE list_max(list_transform(embedding, lambda x: abs(x::FLOAT::DOUBLE))) >= 0.3")
def c03_drop_silent_clips(spark, sf_dir):
    return a.drop_silent_clips(_clips(spark, sf_dir).withColumn("samples", F.col("samples").cast("array<double>")), least=64, peak=0.3).select("clip_id")


@query(f"SELECT session_id, win_idx, win_idx * 48 AS start_sample, round(rms, 6) AS rms FROM {_WIN}")
def c04_rms_windows(spark, sf_dir):
    return a.rms_windows(_sessions(spark, sf_dir), 48).withColumn("rms", F.round("rms", 6))


_GATE = f"(SELECT *, greatest(0.0025, least(0.006, max(rms) OVER (PARTITION BY session_id ORDER BY win_idx) * 0.15)) AS gate FROM (SELECT session_id, win_idx, rms / 20 AS rms FROM {_WIN}))"


@query(f"SELECT session_id, win_idx, round(gate, 9) AS gate, rms >= gate AS voiced FROM {_GATE}")
def c05_adaptive_gate(spark, sf_dir):
    w = a.rms_windows(_sessions(spark, sf_dir), 48).withColumn("rms", F.col("rms") / 20)
    return a.adaptive_gate(w).select("session_id", "win_idx", F.round("gate", 9).alias("gate"), "voiced")


def chunks(spark, sf_dir):
    """Energy series of users as chunks of a second: loud where the value is high."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "value")
    e = e.withColumn("chunk_idx", F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")) - 1)
    # two constant waves, instead of a thousand sines a row
    tone = lambda size: F.lit([size * math.sin(i * 0.9) for i in range(1000)]).cast("array<float>")
    wave = F.when(F.col("event_id") % 7 < 4, tone(0.15)).otherwise(tone(0.0005))
    return e.select("session_id", "chunk_idx", F.lit(1000).alias("sample_rate"), wave.alias("samples"))


@query()
def c06_segment_by_energy(spark, sf_dir):
    return a.segment_by_energy(chunks(spark, sf_dir))


@query("""WITH v AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS win_idx, event_id % 5 < 2 AS voiced FROM events), n AS (SELECT *, coalesce(win_idx - lag(win_idx) OVER (PARTITION BY session_id ORDER BY win_idx) - 1 >= 3, true) AS f FROM v WHERE voiced),
s AS (SELECT *, sum(f::INT) OVER (PARTITION BY session_id ORDER BY win_idx) AS seg_idx FROM n) SELECT session_id, seg_idx::BIGINT AS seg_idx, min(win_idx) AS first_win, max(win_idx) AS last_win FROM s GROUP BY 1, 2""")
def c07_pause_segments(spark, sf_dir):
    return a.pause_segments(_numbered(spark, sf_dir).withColumn("voiced", F.col("event_id") % 5 < 2), 3)


def _numbered(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("user_id").alias("clip_id"), "event_id")
    return e.withColumn("win_idx", F.row_number().over(Window.partitionBy("session_id").orderBy("event_id")))


_VAD = """WITH p AS (SELECT user_id AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id * 37 % 100) / 100.0 AS p FROM events), s AS (SELECT *, coalesce(last_value(CASE WHEN p >= 0.5 THEN 1 WHEN p < 0.35 THEN 0 END IGNORE NULLS) OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS s FROM p),
b AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY c ORDER BY i), 0) AS b FROM s), g AS (SELECT *, sum((s = 1 AND b = 0)::INT) OVER (PARTITION BY c ORDER BY i) AS g FROM b), r AS (SELECT c AS clip_id, min(i) * 512 AS start_sample, (max(i) + 1) * 512 AS end_sample FROM g WHERE s = 1 OR b = 1 GROUP BY c, g) """


def _raw(spark, sf_dir):
    return a.vad_hysteresis(_numbered(spark, sf_dir).withColumn("prob", (F.col("event_id") * 37 % 100) / 100.0))


@query(_VAD + "SELECT * FROM r")
def c08_vad_hysteresis(spark, sf_dir):
    return _raw(spark, sf_dir)


@query()
def c09_vad_merge(spark, sf_dir):
    clips = _numbered(spark, sf_dir).groupBy("clip_id").agg(((F.max("win_idx") + 1) * 512).alias("n_samples"))
    return a.vad_merge(_raw(spark, sf_dir), clips)


#: Raw segments of clips of 1,000,000 samples at 16 kHz, and what they become: near ones merge (gaps under 12,160), short ones go (up to
#: 3,040), all are padded by 480, long ones are split at 879,040, and the clip's end counts as a segment.
_VAD_CASES = (
    (((10000, 50000), (60000, 90000)), ((9520, 90480),)),
    (((10000, 50000), (62160, 90000)), ((9520, 50480), (61680, 90480))),
    (((10000, 13040), (40000, 43041)), ((39520, 43521),)),
    (((0, 900000),), ((0, 879520), (878560, 900480))),
    (((0, 870000), (875000, 900000)), ((0, 870480), (874520, 900480))),
    (((300, 4000), (990000, 995000)), ((0, 4480), (989520, 1000000))),
    (((100, 2000), (14159, 20000), (32159, 33000)), ((0, 33480),)),
)


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"({k}, {a}, {b})" for k, (_, out) in enumerate(_VAD_CASES) for a, b in out)}) v(k, a, b))
SELECT o_orderkey AS clip_id, a::BIGINT AS start_sample, b::BIGINT AS end_sample, (b - a) / 16.0::DOUBLE AS duration_ms FROM orders JOIN c ON k = o_orderkey % {len(_VAD_CASES)}""")
def c09_known_vad_merge(spark, sf_dir):
    k = F.col("o_orderkey")
    cases = F.array(*(F.array(*(F.struct(F.lit(x).alias("start_sample"), F.lit(y).alias("end_sample")) for x, y in raw)) for raw, _ in _VAD_CASES))
    clips = table(spark, sf_dir, "orders").select(k.alias("clip_id"), F.lit(1_000_000).alias("n_samples"))
    raw = clips.select("clip_id", F.explode(F.get(cases, (F.col("clip_id") % len(_VAD_CASES)).cast("int"))).alias("s")).select("clip_id", "s.*")
    return a.vad_merge(raw, clips)


@query(_VAD + "SELECT u AS clip_id, coalesce(start_sample, 0) AS start_sample, coalesce(end_sample, 9999) AS end_sample FROM (SELECT DISTINCT user_id AS u FROM events UNION ALL SELECT DISTINCT -1 - user_id FROM events) LEFT JOIN r ON clip_id = u")
def c10_no_speech_fallback(spark, sf_dir):
    clips = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.lit(9999).cast("long").alias("n_samples")).distinct()
    silent = clips.withColumn("clip_id", -1 - F.col("clip_id"))
    return a.no_speech_fallback(clips.unionAll(silent), _raw(spark, sf_dir))


@query(f"""WITH RECURSIVE c AS (SELECT clip_id, n, 0::BIGINT AS i, 0::BIGINT AS s, least(n, 448000) AS e, n <= 448000 AS stop FROM {_LEN} UNION ALL
SELECT clip_id, n, i + 1, s + 432000, CASE WHEN n - (s + 432000) < 32000 THEN n ELSE least(s + 880000, n) END, n - (s + 432000) < 32000 FROM c WHERE NOT stop AND s + 432000 < n) SELECT clip_id, i AS chunk_idx, s AS start_sample, e AS end_sample FROM c""")
def c11_fixed_chunks(spark, sf_dir):
    return a.fixed_chunks(_lengths(spark, sf_dir))


@query(f"SELECT clip_id, i AS chunk_idx, CASE WHEN i > 0 THEN i * 206080 - 1280 ELSE 0 END AS start_sample, least(i * 206080 + 238080, n) AS end_sample FROM (SELECT clip_id, n, unnest(range(0, greatest(0, ceil((n - 238080) / 206080.0)::BIGINT) + 1)) AS i FROM {_LEN})")
def c12_context_chunks(spark, sf_dir):
    return a.context_chunks(_lengths(spark, sf_dir))


@query("SELECT vec_id AS clip_id, s AS start_sample, round(list_sum(list_transform(embedding[s + 1:least(s + 28, 64)], lambda x: x::FLOAT::DOUBLE)), 5) AS total FROM embeddings, (SELECT unnest([0, 20, 40]) AS s)")
def c13_slice_audio(spark, sf_dir):
    c = _clips(spark, sf_dir)
    plan = c.select("clip_id", F.explode(F.array(*map(F.lit, (0, 20, 40)))).alias("start_sample")).withColumn("end_sample", F.least(F.col("start_sample") + 28, F.lit(64)))
    return a.slice_audio(c, plan).select("clip_id", "start_sample", F.round(F.aggregate("samples", F.lit(0.0), lambda x, y: x + y.cast("double")), 5).alias("total"))


@query("SELECT vec_id AS clip_id, 5 AS n_frames, 4 AS valid_frames, 640 AS n_values FROM embeddings")
def c14_log_mel(spark, sf_dir):
    c = _clips(spark, sf_dir).select("clip_id", F.flatten(F.array_repeat("samples", 10)).alias("samples"))
    return c.select("clip_id", a.log_mel(F.col("samples")).alias("m")).select("clip_id", "m.n_frames", "m.valid_frames", F.size("m.mel").alias("n_values"))


#: Slaney's mel scale and the filters on 257 bins; an impulse of size a at sample 400 is, with pre-emphasis, a and -0.97 a: in frame f it stands
#: at places 656 - 160 f of the 512, under a Hann window of 400 from place 56.
_MEL_SQL = """WITH m AS (SELECT i, CASE WHEN x < 15 THEN x * 200 / 3 ELSE 1000 * exp(ln(6.4) / 27 * (x - 15)) END AS hz FROM (SELECT i, i * (15 + ln(8) * 27 / ln(6.4)) / 129 AS x FROM (SELECT unnest(range(130)) AS i))),
b AS (SELECT unnest(range(257)) AS k), w AS (SELECT lo.i AS band, k, greatest(0, least((k * 31.25 - lo.hz) / (mid.hz - lo.hz), (hi.hz - k * 31.25) / (hi.hz - mid.hz))) * 2 / (hi.hz - lo.hz) AS w FROM m lo JOIN m mid ON mid.i = lo.i + 1 JOIN m hi ON hi.i = lo.i + 2, b),
f AS (SELECT f, CASE WHEN p BETWEEN 56 AND 455 THEN 0.5 - 0.5 * cos(2 * pi() * (p - 56) / 399) ELSE 0 END AS h0, CASE WHEN p + 1 BETWEEN 56 AND 455 THEN 0.5 - 0.5 * cos(2 * pi() * (p - 55) / 399) ELSE 0 END AS h1 FROM (SELECT f, 656 - 160 * f AS p FROM (SELECT unnest(range(6)) AS f))),
a AS (SELECT DISTINCT p_size AS a FROM part),
e AS (SELECT a, f, band, ln(sum(w * a * a * (h0 * h0 + 0.97 * 0.97 * h1 * h1 - 2 * 0.97 * h0 * h1 * cos(2 * pi() * k / 512))) + power(2, -24)) AS v FROM a, f, w GROUP BY a, f, band)
SELECT a AS clip_id, f AS frame, round(avg(v), 2) AS mean, round(max(v), 2) AS top FROM e GROUP BY a, f"""


@query(_MEL_SQL)
def c14_known_impulses(spark, sf_dir):
    """Mel energies of single impulses, whose spectrum is known."""
    clips = table(spark, sf_dir, "part").select(F.col("p_size").alias("clip_id")).distinct()
    clips = clips.withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(959)), lambda i: F.when(i == 400, F.col("clip_id")).otherwise(0).cast("float")))
    m = clips.select("clip_id", a.log_mel(F.col("samples")).alias("m"))
    v = m.select("clip_id", F.posexplode("m.mel").alias("i", "v"))
    frame = F.floor(F.col("i") / 128)
    return v.where(frame < 6).groupBy("clip_id", frame.alias("frame")).agg(F.round(F.avg(F.col("v").cast("double")), 2).alias("mean"), F.round(F.max(F.col("v").cast("double")), 2).alias("top"))


_FEAT = "(SELECT vec_id // 50 AS c, vec_id % 50 AS frame, i - 1 AS band, embedding[i]::FLOAT::DOUBLE AS x, vec_id % 50 < 40 AS valid FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


@query(f"SELECT c AS clip_id, frame, band::INTEGER AS band, round(CASE WHEN valid THEN (x - avg(x) FILTER (valid) OVER w) / (stddev_samp(x) FILTER (valid) OVER w + 1e-5) ELSE 0 END, 5) + 0 AS value FROM {_FEAT} WINDOW w AS (PARTITION BY c, band)")
def c15_cmvn(spark, sf_dir):
    f = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("clip_id"), (F.col("vec_id") % 50).alias("frame"), F.posexplode("embedding").alias("band", "x"))
    f = f.select("clip_id", "frame", "band", F.col("x").cast("double").alias("value"), (F.col("frame") < 40).alias("valid"))
    return a.cmvn(f).select("clip_id", "frame", "band", (F.round("value", 5) + 0).alias("value"))


@query("SELECT vec_id AS clip_id, 80 AS n, round(list_min(embedding)::FLOAT::DOUBLE, 5) AS last FROM embeddings")
def c16_pad_to_width(spark, sf_dir):
    p = _clips(spark, sf_dir).select("clip_id", a.pad_to_width(F.col("samples"), 80).alias("p"))
    return p.select("clip_id", F.size("p").alias("n"), F.round(F.element_at("p", -1).cast("double"), 5).alias("last"))


@query("""WITH v AS (SELECT vec_id // 10 AS session_id, vec_id % 10 AS seg_idx, (vec_id * 7 % 60 + 1)::INT AS valid, embedding FROM embeddings),
m AS (SELECT *, max(valid) OVER (PARTITION BY session_id, seg_idx // 4) AS n FROM v)
SELECT session_id, seg_idx, seg_idx // 4 AS batch, valid, n, CASE WHEN valid < n THEN 0 ELSE round(embedding[n]::FLOAT::DOUBLE, 5) END AS last, round(list_sum(list_transform(range(0, valid), lambda i: (i + 1) * embedding[i + 1]::FLOAT::DOUBLE)), 3) AS weighed FROM m""")
def c17_batch_pad(spark, sf_dir):
    s = _sessions(spark, sf_dir).select("session_id", F.col("chunk_idx").alias("seg_idx"), F.slice("samples", F.lit(1), ((F.col("session_id") * 10 + F.col("chunk_idx")) * 7 % 60 + 1).cast("int")).alias("samples"))
    return a.batch_pad(s, 4).select("session_id", "seg_idx", "batch", "valid", F.size("samples").alias("n"), F.round(F.element_at("samples", -1).cast("double"), 5).alias("last"), _weighed("samples").alias("weighed"))


def _energy(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("t"), (F.col("event_id") * 13 % 50).alias("avg"))


_EN = "(SELECT user_id AS session_id, event_id AS t, event_id * 13 % 50 AS a FROM events)"


@query(f"WITH s AS (SELECT *, avg((a <= 10)::INT) OVER w AS share, min(t) OVER w AS t0 FROM {_EN} WINDOW w AS (PARTITION BY session_id ORDER BY t)) SELECT session_id, min(t) AS flagged_at FROM s WHERE t - t0 >= 300 AND share >= 0.25 GROUP BY 1")
def c18_silence_ratio_guard(spark, sf_dir):
    return a.silence_ratio_guard(_energy(spark, sf_dir), ratio=0.25, after_s=300)


@query(f"WITH s AS (SELECT *, coalesce(max(CASE WHEN a > 10 THEN t END) OVER w, min(t) OVER w) AS sound FROM {_EN} WINDOW w AS (PARTITION BY session_id ORDER BY t)) SELECT session_id, min(t) AS stop_at FROM s WHERE t - sound > 200 GROUP BY 1")
def c19_auto_stop_point(spark, sf_dir):
    return a.auto_stop_point(_energy(spark, sf_dir), 200)


@query("SELECT vec_id AS clip_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE '64 samples' END AS text, CASE WHEN vec_id % 5 = 0 THEN 'ValueError: no samples' END AS error FROM embeddings")
def i01_transcribe_segments(spark, sf_dir):
    def fn(x):
        if not len(x):
            raise ValueError("no samples")
        return f"{len(x)} samples"

    c = _clips(spark, sf_dir).withColumn("samples", F.when(F.col("clip_id") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("samples")))
    return a.transcribe_segments(c, fn).select("clip_id", "text", "error")


@query("""WITH s AS (SELECT vec_id // 7 AS session_id, count(*) AS n, count(*) FILTER (vec_id % 11 = 0) AS bad FROM embeddings GROUP BY 1)
SELECT session_id, CASE WHEN bad = 0 THEN array_to_string(list_transform(range(n), lambda x: 'part of 64 samples.'), ' ') WHEN session_id % 2 = 0 THEN 'batch ' || session_id ELSE 'other ' || session_id END AS text, CASE WHEN bad = 0 THEN 'stream' WHEN session_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS engine FROM s""")
def i01_failed_segments(spark, sf_dir):
    """Sessions of seven clips: where one fails, the session goes to the other engines' texts."""
    from ..operators import segments as seg

    def fn(x):
        if not len(x):
            raise ValueError("no samples")
        return f"part of {len(x)} samples."

    clips = _clips(spark, sf_dir).select(F.floor(F.col("clip_id") / 7).alias("session_id"), F.col("clip_id").alias("seg_idx"), F.lit(True).alias("forced_split"), F.when(F.col("clip_id") % 11 == 0, F.array().cast("array<float>")).otherwise(F.col("samples")).alias("samples"))
    streamed = a.streamed_texts(a.transcribe_segments(clips, fn))
    sessions = clips.select("session_id").distinct()
    batch = lambda name, said: sessions.select("session_id", F.when(said, F.concat(F.lit(name), "session_id")).otherwise("").alias("text"))
    return seg.engine_fallback(sessions, streamed, batch("batch ", F.col("session_id") % 2 == 0), batch("other ", F.lit(True)))
