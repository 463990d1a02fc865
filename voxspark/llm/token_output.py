"""Token ids as Parquet list columns.

Documents are ranged by doc_id, encoded by the tokenizers library (each distinct unit
of a batch once, see bpe.UnitCoder) and written as one list column a document beside
small metadata columns.  The files have bounded row groups and pages, dictionary or
delta (writer version 2) encoding and page indexes, so that a reader takes the columns
and doc_id ranges it needs only.  File names and rows ascend with doc_id.

Defined results: null text counts as empty and has the end id alone; a null doc_id
comes first; equal ids keep the order of the file; an empty table gives no rows; extra
columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import steps, text_bytes
from .bpe import UNIT_STEP, UnitCoder, list_column

#: Of the written files.
PARQUET_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(512 << 10),
    "parquet.page.row.count.limit": "2000",
}
SCHEMA = "doc_id long, n_tokens long, ids array<int>"
#: Units joined in one call of the library.
JOINED_UNITS = 8000
_held: dict[str, UnitCoder] = {}


def _coder(path: str) -> UnitCoder:
    if path not in _held:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        size = np.zeros(library.get_vocab_size(), np.int64)
        for token, i in library.get_vocab().items():
            size[i] = len(token)  # one character stands for a byte

        def encode_words(words: list[str]) -> list[list[int]]:
            """Most units are encoded joined, as no piece crosses their ends.

            Those with a leading space as they are, those that are letters and digits only
            behind a newline, which is an id of its own; others alone.
            """
            out: list = [None] * len(words)
            alone, groups = [], [[], []]
            for i, w in enumerate(words):
                if len(w) > 1 and w[0] == " " and all(x.isalnum() or "!" <= x <= "~" for x in (w[1], w[-1])):
                    groups[0].append(i)
                elif w.isalnum():
                    groups[1].append(i)
                else:
                    alone.append(i)
            for i, e in zip(alone, library.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
                out[i] = e.ids
            for lead, group in zip(("", "\n"), groups, strict=True):
                for lo in range(0, len(group), JOINED_UNITS):
                    part = group[lo:lo + JOINED_UNITS]
                    texts = [lead + words[i] for i in part]
                    ids = library.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids
                    cut = [0, *(np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(t.encode()) for t in texts])) + 1).tolist()]
                    for i, a, b in zip(part, cut[:-1], cut[1:], strict=True):
                        out[i] = ids[a + len(lead):b]
            return out

        _held[path] = UnitCoder(encode_words)
    return _held[path]


def _added(path: str) -> tuple[re.Pattern | None, dict[bytes, int]]:
    """A pattern of the tokenizer's added tokens (of several at a place the longest), and their ids."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_added_tokens_decoder()
    if odd := [t.content for t in found.values() if t.lstrip or t.rstrip or t.single_word or t.normalized]:
        raise ValueError(f"added tokens that are more than their literal: {odd}")
    ids = {t.content.encode(): i for i, t in found.items()}
    return re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(ids, key=len, reverse=True)) + b")") if ids else None, ids


def _encode_with_added(coder: UnitCoder, texts: list[bytes], pattern: re.Pattern, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """As coder.encode, but texts are cut at added tokens, which have ids of their own."""
    parts: list[bytes] = []
    marks, ids, last = [], [], []  # parts before each added token, its id, parts up to each text's end
    for t in texts:
        cut = pattern.split(t)
        for i, x in enumerate(cut):
            if i % 2:
                marks.append(len(parts))
                ids.append(added[x])
            else:
                parts.append(x)
        last.append(len(parts))
    flat, offsets = coder.encode(parts)
    ends = offsets[np.array(last, np.int64)] + np.searchsorted(np.array(marks, np.int64), last)
    flat = np.insert(flat, offsets[np.array(marks, np.int64)], np.array(ids, np.int32))
    return flat, np.concatenate(([0], ends))


def write_tokens(docs: DataFrame, out_path: str, tokenizer_path: str, end_id: int, added_tokens: bool = False) -> None:
    """Encode doc_id, text to Parquet files in ascending doc_id order.

    added_tokens: literals of the tokenizer's added tokens get their ids, as the library
    does by default; else special ones are encoded as any other text (its switch
    encode_special_tokens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path)
        pattern, added = _added(tokenizer_path) if added_tokens else (None, {})
        for batch in steps(batches, size=UNIT_STEP):
            texts = text_bytes(batch)
            flat, offsets = _encode_with_added(coder, texts, pattern, added) if pattern else coder.encode(texts)
            flat = np.insert(flat, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), list_column(flat, offsets)], ["doc_id", "n_tokens", "ids"])

    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ranged.mapInArrow(run, SCHEMA).write.options(**PARQUET_OPTIONS).parquet(out_path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Selected columns of the written files; filters on doc_id reach row groups and pages."""
    return spark.read.schema(SCHEMA).parquet(path).select(*columns)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        flat = np.asarray(lists.flatten(), "<u4")
        ends = np.cumsum(np.asarray(lists.value_lengths(), np.int64)).tolist()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        others = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in others), pa.array([b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())], [*others, "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    Prefix sums run inside each file; only one total per file is summed over files.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    rows = rows.mapInArrow(_crc, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    sizes = spark.read.schema(SCHEMA).parquet(path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "n_tokens")
    files = sizes.groupBy("file").agg(F.min("doc_id").alias("low"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy(F.col("low").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
