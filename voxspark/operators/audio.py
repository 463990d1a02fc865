"""Audio in array columns: chunks, voice windows, segments, mel features."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATE = 16_000
WINDOW_MS, CLOSE_MS, VOICED_MS, SOFT_MS, LOOK_MS, MAX_MS, TAIL_MS = 32, 650, 550, 15_000, 6_000, 28_000, 250
GATE_FLOOR, GATE_CEIL, GATE_SHARE = 0.0025, 0.006, 0.15


def _rows(s: pd.Series) -> Iterator[np.ndarray]:
    return (np.asarray(x, np.float32) for x in s)


def resample_cubic(samples: Column, source: Column, target: int = RATE) -> Column:
    """Catmull-Rom interpolation to another rate; half-up length, ends repeated."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for a, r in zip(_rows(s), rate, strict=True):
            if r == target or not len(a):
                out.append(a)
                continue
            ratio = r / target
            at = np.arange(int(np.floor(len(a) / ratio + 0.5))) * ratio
            i = np.floor(at).astype(int)
            t = at - i
            p = [a[np.clip(i + k, 0, len(a) - 1)].astype(np.float64) for k in (-1, 0, 1, 2)]
            out.append((((0.5 * (p[3] - p[0]) + 1.5 * (p[1] - p[2])) * t + p[0] - 2.5 * p[1] + 2 * p[2] - 0.5 * p[3]) * t + 0.5 * (p[2] - p[0])) * t + p[1])
        return pd.Series([np.asarray(x, np.float32) for x in out])

    return run(samples, source)


def drop_silent_clips(df: DataFrame, samples: str = "samples", recorded_ms: str | None = None, least: int = 8000, peak: float = 0.001) -> DataFrame:
    loud = F.array_max(F.transform(samples, F.abs)) >= peak
    keep = (F.size(samples) >= least) & loud
    return df.where(keep & (F.col(recorded_ms) >= 1000) if recorded_ms else keep)


def rms_windows(df: DataFrame, window: int, session: str = "session_id", chunk: str = "chunk_idx", samples: str = "samples") -> DataFrame:
    """session, win_idx, start_sample, rms of whole windows; what is left goes to the next chunk."""
    w = Window.partitionBy(session).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    at = df.withColumn("base", F.coalesce(F.sum(F.coalesce(F.size(samples), F.lit(0))).over(w), F.lit(0)).cast("long"))
    kind = df.schema[session].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk and window with the sum of squares and the number of samples there."""
        for batch in batches:
            keys, wins, sums, sizes = [], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for row, (base, x) in enumerate(zip(batch.column("base").to_pylist(), batch.column(samples), strict=True)):
                a = np.asarray(x.values, np.float64) if x.is_valid else np.zeros(0)
                if len(a):
                    first = np.arange(base // window, (base + len(a) - 1) // window + 1)
                    at = np.maximum(first * window - base, 0)
                    wins.append(first)
                    sums.append(np.add.reduceat(a * a, at))
                    sizes.append(np.diff(np.append(at, len(a))))
                    keys += [row] * len(first)
            yield pa.RecordBatch.from_arrays([batch.column(session).take(pa.array(keys, pa.int64())), pa.array(np.concatenate(wins)), pa.array(np.concatenate(sums)), pa.array(np.concatenate(sizes))], [session, "win_idx", "e", "n"])

    part = at.select(session, "base", samples).mapInArrow(run, f"`{session}` {kind}, win_idx long, e double, n long")
    g = part.groupBy(session, "win_idx").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where(F.col("n") == window)
    return g.select(session, "win_idx", (F.col("win_idx") * window).alias("start_sample"), F.sqrt(F.col("e") / window).alias("rms"))


def adaptive_gate(windows: DataFrame, session: str = "session_id") -> DataFrame:
    w = Window.partitionBy(session).orderBy("win_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gate = F.greatest(F.lit(GATE_FLOOR), F.least(F.lit(GATE_CEIL), F.max("rms").over(w) * GATE_SHARE))
    return windows.withColumn("gate", gate).withColumn("voiced", F.col("rms") >= F.col("gate"))


class Segmenter:
    """The open segment of a session, chunk by chunk: window energies and counters, no samples."""

    def __init__(self, rate: int):
        self.rate, self.window = rate, max(1, int(WINDOW_MS / 1000 * rate + 0.5))
        self.open = self.begin = self.index = 0
        self.voiced = self.silence = 0
        self.peak = 0.0
        self.carry = np.zeros(0, np.float32)
        self.seen: list[tuple[int, float]] = []

    def gate(self) -> float:
        return max(GATE_FLOOR, min(GATE_CEIL, self.peak * GATE_SHARE))

    def push(self, chunk: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """Closed segments (index, start sample, end sample, forced)."""
        if not len(chunk):
            return []
        data = np.concatenate((self.carry, chunk)).astype(np.float32)
        first = self.open - len(self.carry)
        self.open += len(chunk)
        whole = len(data) // self.window
        for k, e in enumerate(np.sqrt((data[:whole * self.window].astype(np.float64).reshape(-1, self.window) ** 2).mean(axis=1)).tolist() if whole else []):
            self.seen.append((max(0, first + k * self.window), e))
            self.peak = max(self.peak, e)
            if e >= self.gate():
                self.voiced, self.silence = self.voiced + WINDOW_MS, 0
            else:
                self.silence += WINDOW_MS
        self.carry = data[whole * self.window:]
        ms = self.open / self.rate * 1000
        paused = self.silence >= CLOSE_MS and self.voiced >= VOICED_MS
        if paused or ms >= MAX_MS:
            return self._close(self.open, not paused)
        if ms >= SOFT_MS and self.voiced >= VOICED_MS:
            recent = [w for w in self.seen if w[0] >= self.open - int(LOOK_MS / 1000 * self.rate + 0.5)]
            if recent:
                quiet = min(e for _, e in recent)
                at = max(s for s, e in recent if e == quiet)
                if at > 0:
                    return self._close(at, True)
        return []

    def finish(self) -> list[tuple[int, int, int, bool]]:
        if self.open / self.rate * 1000 >= TAIL_MS and self.voiced > 0:
            self.voiced = max(self.voiced, VOICED_MS)
            return self._close(self.open, False)
        return []

    def _close(self, cut: int, forced: bool) -> list[tuple[int, int, int, bool]]:
        if not self.open:
            return []
        cut, had = min(cut, self.open), self.voiced >= VOICED_MS
        out = [(self.index, self.begin, self.begin + cut, forced)] if had else []
        self.index += had
        self.begin, self.open, self.silence = self.begin + cut, self.open - cut, 0
        self.seen = [(s - cut, e) for s, e in self.seen if s >= cut] if self.open else []
        self.voiced = WINDOW_MS * sum(e >= self.gate() for _, e in self.seen)
        return out


def segment_by_energy(chunks: DataFrame, session: str = "session_id") -> DataFrame:
    """session, seg_idx, start_sample, end_sample, forced of ordered chunks (chunk_idx, sample_rate, samples).

    A fold over partitions sorted by session and chunk: chunks stream by, and only the open
    segment of one session is held.
    """
    kind = chunks.schema[session].dataType.simpleString()
    names = [session, "seg_idx", "start_sample", "end_sample", "forced"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, s, key_type = None, None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 5
            types = [key_type, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            rows, key_type = [], batch.schema.field(session).type
            for key, rate, x in zip(*(batch.column(c) for c in (session, "sample_rate", "samples")), strict=True):
                key = key.as_py()
                if s is None or key != current:
                    rows += [(current, *r) for r in s.finish()] if s else []
                    current, s = key, Segmenter(rate.as_py())
                if x.is_valid:
                    rows += [(current, *r) for r in s.push(np.asarray(x.values, np.float32))]
            yield out(rows)
        if s:
            yield out([(current, *r) for r in s.finish()])

    rows = chunks.select(session, "chunk_idx", "sample_rate", "samples").repartition(session).sortWithinPartitions(session, "chunk_idx")
    return rows.mapInArrow(run, f"`{session}` {kind}, seg_idx long, start_sample long, end_sample long, forced boolean")


def _islands(df: DataFrame, key: str, order: str, flag: Column, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn(name, F.sum(flag.cast("int")).over(w))


def pause_segments(windows: DataFrame, gap: int, session: str = "session_id") -> DataFrame:
    """A new segment after `gap` windows without voice: first and last voiced window of each."""
    w = Window.partitionBy(session).orderBy("win_idx")
    v = windows.where("voiced").withColumn("new", F.coalesce(F.col("win_idx") - F.lag("win_idx").over(w) - 1 >= gap, F.lit(True)))
    return _islands(v, session, "win_idx", F.col("new"), "seg_idx").groupBy(session, "seg_idx").agg(F.min("win_idx").alias("first_win"), F.max("win_idx").alias("last_win"))


def vad_hysteresis(probs: DataFrame, window: int = 512, on: float = 0.5, off: float = 0.35, clip: str = "clip_id") -> DataFrame:
    """Raw segments: open at `on` or more, closed below `off`; in between the state stays."""
    w = Window.partitionBy(clip).orderBy("win_idx")
    state = F.last(F.when(F.col("prob") >= on, 1).when(F.col("prob") < off, 0), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    t = probs.withColumn("state", F.coalesce(state, F.lit(0)))
    t = t.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(0)))
    t = _islands(t, clip, "win_idx", (F.col("state") == 1) & (F.col("before") == 0), "seg")
    # the window that closes a segment belongs to it
    return t.where("state = 1 or before = 1").groupBy(clip, "seg").agg((F.min("win_idx") * window).alias("start_sample"), ((F.max("win_idx") + 1) * window).alias("end_sample")).drop("seg")


def vad_merge(raw: DataFrame, clips: DataFrame, clip: str = "clip_id", rate: int = RATE) -> DataFrame:
    """Merge near segments, drop short ones, pad, split long ones; clips has n_samples.

    A fold over partitions sorted by clip and start, which holds the open segment only.
    """
    pad = 30 * rate // 1000
    least, most, gap = 250 * rate // 1000 - 2 * pad, 55 * rate - 2 * pad, 700 * rate // 1000 + 2 * pad
    kind = raw.schema[clip].dataType.simpleString()

    names = [clip, "start_sample", "end_sample", "duration_ms"]

    def merged(held: tuple[int, int] | None, seg: tuple[int, int] | None, n: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
        """What is final once seg has come (null: the end), and the segment that is open then."""
        out: list[tuple[int, int]] = []
        if held and seg and seg[0] - held[1] < gap and seg[1] - held[0] < most:
            return out, (held[0], seg[1])
        if held and held[1] - held[0] > least:
            out.append((max(held[0] - pad, 0), min(held[1] + pad, n)))
        if seg is None:
            return out, None
        s = seg[0]
        while seg[1] - s > most:
            out.append((max(s - pad, 0), s + most + pad))
            s += most
        return out, (s, seg[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, n, keys = None, None, None, None

        def ended() -> list[tuple]:
            """The clip's end counts as a segment without length."""
            first, open_ = merged(held, (n, n), n)
            return [(current, *x) for x in (*first, *merged(open_, None, n)[0])]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            rows = [(*r, (r[2] - r[1]) / rate * 1000) for r in rows]
            types = [keys, pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            rows, keys = [], batch.schema.field(clip).type
            for key, a, b, size in zip(*(batch.column(c).to_pylist() for c in (clip, "start_sample", "end_sample", "n_samples")), strict=True):
                if n is None or key != current:
                    rows += ended() if n is not None else []
                    current, held, n = key, None, size
                done, held = merged(held, (a, b), n)
                rows += [(current, *x) for x in done]
            yield out(rows)
        if n is not None:
            yield out(ended())

    rows = raw.select(clip, F.col("start_sample").cast("long").alias("start_sample"), F.col("end_sample").cast("long").alias("end_sample")).join(clips.select(clip, F.col("n_samples").cast("long").alias("n_samples")), clip)
    return rows.repartition(clip).sortWithinPartitions(clip, "start_sample").mapInArrow(run, f"`{clip}` {kind}, start_sample long, end_sample long, duration_ms double")


def no_speech_fallback(clips: DataFrame, segments: DataFrame, clip: str = "clip_id") -> DataFrame:
    j = clips.select(clip, "n_samples").join(segments.select(clip, "start_sample", "end_sample"), clip, "left")
    return j.select(clip, F.coalesce("start_sample", F.lit(0)).alias("start_sample"), F.coalesce("end_sample", "n_samples").alias("end_sample"))


def fixed_chunks(clips: DataFrame, size: int = 28 * RATE, overlap: int = RATE, tail: int = 2 * RATE, clip: str = "clip_id") -> DataFrame:
    """Chunks of `size` that share `overlap`; what starts less than `tail` before the end is cut as it is and ends the plan."""
    n, step = F.col("n_samples"), size - overlap
    # starts 0, step, ... up to the first with less than `tail` left
    last = F.when(n <= size, 0).otherwise(F.greatest(F.ceil((n - tail + 1) / step), F.lit(1)))
    t = clips.select(clip, "n_samples", last.cast("long").alias("last")).select(clip, "n_samples", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"))
    start = F.col("i") * step
    return t.where((start < n) | (F.col("i") == 0)).select(clip, F.col("i").alias("chunk_idx"), start.alias("start_sample"), F.when((F.col("i") == F.col("last")) & (F.col("last") > 0), n).otherwise(F.least(start + size, n)).alias("end_sample"))


def context_chunks(clips: DataFrame, size: int = 238_080, stride: int = 206_080, context: int = 1280, clip: str = "clip_id") -> DataFrame:
    n = F.col("n_samples")
    last = F.greatest(F.ceil((n - size) / stride), F.lit(0)).cast("long")
    t = clips.select(clip, "n_samples", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))
    s = F.col("chunk_idx") * stride
    return t.select(clip, "chunk_idx", F.when(F.col("chunk_idx") > 0, s - context).otherwise(s).alias("start_sample"), F.least(s + size, n).alias("end_sample"))


def slice_audio(clips: DataFrame, plan: DataFrame, clip: str = "clip_id", samples: str = "samples") -> DataFrame:
    j = plan.join(clips.select(clip, samples), clip)
    return j.withColumn(samples, F.slice(samples, (F.col("start_sample") + 1).cast("int"), (F.col("end_sample") - F.col("start_sample")).cast("int")))


@functools.cache
def _mel_filters(n_mels: int = 128, n_fft: int = 512, rate: int = RATE) -> np.ndarray:
    """Triangles on the Slaney mel scale, each of unit area."""
    step, knee, log_step = 200 / 3, 1000.0, np.log(6.4) / 27
    to_mel = lambda f: f / step if f < knee else knee / step + np.log(f / knee) / log_step
    mel = np.linspace(0, to_mel(rate / 2), n_mels + 2)
    hz = np.where(mel < knee / step, mel * step, knee * np.exp(log_step * (mel - knee / step)))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up, down = (bins - hz[:-2, None]) / np.diff(hz)[:-1, None], (hz[2:, None] - bins) / np.diff(hz)[1:, None]
    return (np.maximum(0, np.minimum(up, down)) * (2 / (hz[2:] - hz[:-2]))[:, None]).astype(np.float32)


def mel_frames(a: np.ndarray) -> np.ndarray:
    """[frames, 128] log mel energies: pre-emphasis 0.97, a 400-sample Hann window in 512, hop 160."""
    a = a.astype(np.float32)
    x = np.concatenate((a[:1], a[1:] - np.float32(0.97) * a[:-1]))
    x = np.concatenate((np.zeros(256, np.float32), x, np.zeros(256, np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(x, 512)[::160]
    window = np.zeros(512, np.float32)
    window[56:456] = np.hanning(400)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    return np.log(power.astype(np.float32) @ _mel_filters().T + np.float32(2**-24)).astype(np.float32)


def log_mel(samples: Column) -> Column:
    """struct(mel (frame-major), n_frames, valid_frames)."""

    @F.pandas_udf("mel array<float>, n_frames int, valid_frames int")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(m.ravel(), len(m), len(a) // 160) for a in _rows(s) for m in (mel_frames(a) if len(a) else np.zeros((0, 128), np.float32),)]
        return pd.DataFrame(rows, columns=["mel", "n_frames", "valid_frames"])

    return run(samples)


def cmvn(features: DataFrame, clip: str = "clip_id") -> DataFrame:
    """Rows (clip, frame, band, value, valid): normalised over valid frames, 0 elsewhere."""
    w = Window.partitionBy(clip, "band")
    v = F.when(F.col("valid"), F.col("value"))
    return features.withColumn("value", F.when(F.col("valid"), (F.col("value") - F.avg(v).over(w)) / (F.coalesce(F.stddev_samp(v).over(w), F.lit(0.0)) + 1e-5)).otherwise(0.0))


def pad_to_width(row: Column, width: int = 2800) -> Column:
    """A band's frames, filled up with their own minimum; longer ones stay."""
    return F.when(F.size(row) < width, F.concat(row, F.array_repeat(F.array_min(row), F.lit(width) - F.size(row)))).otherwise(row)


def batch_pad(df: DataFrame, n: int = 8, order: str = "seg_idx", key: str = "session_id", row: str = "samples") -> DataFrame:
    """Batches of n segments, each padded with zeros to the batch's longest; valid keeps the length."""
    w = Window.partitionBy(key).orderBy(order)
    t = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n)).withColumn("valid", F.size(row))
    t = t.withColumn("_m", F.max("valid").over(Window.partitionBy(key, "batch")))
    zero = F.lit(0.0).cast("float")
    return t.withColumn(row, F.concat(row, F.array_repeat(zero, F.col("_m") - F.col("valid")))).drop("_m")


def silence_ratio_guard(energy: DataFrame, key: str = "session_id", ratio: float = 0.8, after_s: float = 30.0) -> DataFrame:
    """First time from after_s on at which that share of the samples so far is silent (avg <= 10)."""
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = energy.withColumn("share", F.avg((F.col("avg") <= 10).cast("double")).over(w)).withColumn("t0", F.min("t").over(w))
    return t.where((F.col("t") - F.col("t0") >= after_s) & (F.col("share") >= ratio)).groupBy(key).agg(F.min("t").alias("flagged_at"))


def auto_stop_point(energy: DataFrame, duration_s: float, key: str = "session_id") -> DataFrame:
    """First time at which the last sound (avg > 10) lies further back than duration_s."""
    w = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = energy.withColumn("sound", F.coalesce(F.last(F.when(F.col("avg") > 10, F.col("t")), ignorenulls=True).over(w), F.min("t").over(w)))
    return t.where(F.col("t") - F.col("sound") > duration_s).groupBy(key).agg(F.min("t").alias("stop_at"))


def transcribe_segments(segments: DataFrame, fn, samples: str = "samples", text: str = "text") -> DataFrame:
    """A user's function of an array of samples over all segments; a failure gives a null text and its error."""

    @F.pandas_udf("text string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for a in _rows(s):
            try:
                out.append((fn(a), None))
            except Exception as e:  # the segment is unhealthy, not the job
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    return segments.withColumn("_t", run(samples)).withColumns({text: F.col("_t.text"), "error": F.col("_t.error")}).drop("_t")


def streamed_texts(transcribed: DataFrame, session: str = "session_id", idx: str = "seg_idx", text: str = "text", forced: str = "forced_split", error: str = "error") -> DataFrame:
    """session, text, healthy of transcribed segments: their joined text; one failed segment makes a session unhealthy.

    With engine_fallback such a session is given to the other engine.
    """
    from .segments import join_segments

    joined = join_segments(transcribed, session, idx, text, forced).select(session, "text")
    health = transcribed.groupBy(session).agg(F.max(F.col(error).isNotNull()).alias("bad"))
    return health.join(joined, session, "left").select(session, F.coalesce("text", F.lit("")).alias("text"), (~F.col("bad")).alias("healthy"))
