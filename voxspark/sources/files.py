"""Readers of the record files: histories, dictionaries, recipes, audio dumps, vocabularies, event logs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY = "id string, user_id string, text string, timestamp long, app string, audioMs long, latencyMs long, captureLatencyMs long, kind string, pasteReason string"
DICTIONARY = "id string, original string, replacement string, variants array<string>, createdAt long, created_at timestamp"
_TARGET = "struct<name:string,nameFromSlot:string,type:string,invokable:boolean,editable:boolean>"
RECIPES = f"id string, describe string, patterns array<string>, slots array<string>, source string, steps array<struct<action:string,app:string,uri:string,target:{_TARGET},text:string,submit:boolean,keys:array<string>,ms:long>>, stats struct<successes:long,failures:long,quarantined:boolean>"
EVENT = "type string, text string, state string, session_id string, ts long"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the session (spark.checkpoint.dir).

    Where it is unset, in local mode only, a folder of this machine is made for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if root is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
            root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A JSON array of entries; times are epoch milliseconds."""
    h = spark.read.schema(HISTORY).json(path, multiLine=multi_line)
    return h.select("id", "user_id", "text", F.timestamp_millis("timestamp").alias("ts"), "app", F.col("audioMs").alias("audio_ms"), F.col("latencyMs").alias("latency_ms"),
                    F.col("captureLatencyMs").alias("capture_latency_ms"), "kind", F.col("pasteReason").alias("paste_reason"))


def read_dictionary(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    d = spark.read.schema(DICTIONARY).json(path, multiLine=multi_line)
    return d.select("id", "original", "replacement", "variants", F.coalesce("created_at", F.timestamp_millis("createdAt")).alias("created_at"))


def read_recipes(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(RECIPES).json(path, multiLine=multi_line)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, content = batch.column("path").to_pylist(), batch.column("content").to_pylist()
        audio = [np.frombuffer(c[:len(c) // 4 * 4], "<f4") for c in content]
        offsets = np.concatenate(([0], np.cumsum([len(a) for a in audio]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(audio) if audio else np.zeros(0, "<f4")))], ["path", "samples"])


def read_f32_audio(spark: SparkSession, glob: str) -> DataFrame:
    """Raw mono dumps named ...-<ms>-<rate>hz.f32: clip_id, ts, sample_rate, samples."""
    raw = spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(_samples, "path string, samples array<float>")
    part = lambda i: F.regexp_extract("path", r"([^/]*?)-(\d+)-(\d+)hz\.f32$", i)
    return raw.select(F.regexp_extract("path", r"([^/]*)\.f32$", 1).alias("clip_id"), F.timestamp_millis(part(2).cast("long")).alias("ts"), part(3).cast("int").alias("sample_rate"), "samples")


def write_f32_audio(clips: DataFrame, folder: str) -> None:
    """clips (clip_id, ms, sample_rate, samples) as one raw dump each, in a folder that all executors share.

    A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for clip, ms, rate, samples in zip(*(batch.column(c) for c in ("clip_id", "ms", "sample_rate", "samples")), strict=True):
                with files.open_output_stream(f"{root}/{clip}-{ms}-{rate}hz.f32") as out:
                    out.write(np.asarray(samples.values, "<f4").tobytes())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    clips.select("clip_id", "ms", "sample_rate", "samples").mapInArrow(run, "n long").agg({"n": "sum"}).collect()


def event_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of `data: {json}` lines; comments and malformed lines are left out."""
    body = F.regexp_extract(value, r"^data: ?(\{.*\})\s*$", 1)
    e = lines.where(F.col(value).startswith("data:")).select(F.from_json(body, EVENT).alias("e")).where("e.type is not null").select("e.*")
    return e.withColumn("ts", F.timestamp_millis("ts"))


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return event_lines(spark.read.text(path))


def stream_event_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same of files as they come, at most max_files a micro-batch."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    return event_lines(reader.text(path))
