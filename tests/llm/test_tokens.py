import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from voxspark.llm import bpe, queries, token_output
from voxspark.llm.common import fresh_path

from .edge import documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _expected10(rows):
    enc, out = _tiktoken(), {}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    return out


def test_bpe_equals_library_on_odd_texts():
    import random

    rnd, enc = random.Random(3), _tiktoken()
    bits = [" ", "  ", "\n", "\t", " ", "'s", "'ll", "a", "é", "日本", " x", "23", "!!", "　", "\x1c", "\x85", "​", "😀", "\r\n", "<|endoftext|>", "zzzz"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", "a" * 3000, "ab " * 3, " " * 40 + "x"]
    own = bpe.ByteBpe(PATH, PATTERN)
    flat, at = bpe.UnitCoder(own.encode_words).encode([t.encode() for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]
    assert own.decode(flat.astype(np.int64), at) == [t.encode() for t in texts]


def test_unit_cache_may_be_trimmed(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_UNITS", 4)
    own, enc = bpe.ByteBpe(PATH, PATTERN), _tiktoken()
    coder = bpe.UnitCoder(own.encode_words)
    for k in range(5):
        t = " ".join(f"w{k * i}xq" for i in range(9)) + " again and again"
        assert coder.encode([t.encode()])[0].tolist() == enc.encode_ordinary(t)


def test_op10_query(spark, sf):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == _expected10(docs)


def test_op10_edges(spark):
    docs = documents(spark)
    df = bpe.decode(bpe.encode(docs.drop("ids"), PATH, PATTERN), PATH, PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_digests(df).collect()}
    assert got == _expected10([(r.doc_id, r.text) for r in docs.collect()])
    assert queries.bpe_digests(bpe.decode(bpe.encode(docs.drop("ids").limit(0), PATH, PATTERN), PATH, PATTERN)).count() == 0


def _expected3(rows, literals=False):
    """The library's plain call; literals: added tokens are text like any other, as write_tokens takes them by default."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if literals:
        t.encode_special_tokens = True
    out, start = {}, 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_op3_query(spark, sf):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_output(spark, sf).collect()}
    assert got == _expected3([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_op3_edges_and_selective_reads(spark):
    docs, path = documents(spark).drop("ids"), fresh_path(spark, "tokens")
    token_output.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_index(spark, path).collect()}
    assert got == _expected3([(r.doc_id, r.text) for r in docs.collect()], literals=True)
    some = token_output.read_tokens(spark, path, ("doc_id", "n_tokens")).where("doc_id between 3 and 5")
    plan = some._jdf.queryExecution().toString()
    assert some.count() == 3 and "ids" not in plan.split("ReadSchema")[1][:80] and "GreaterThanOrEqual(doc_id,3)" in plan
    empty = fresh_path(spark, "tokens")
    token_output.write_tokens(docs.limit(0), empty, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_output.token_index(spark, empty).count() == 0


def test_op3_added_tokens_as_the_library_by_default(spark, tmp_path):
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"x{end}\n{end} y\n", "none", "", None, f"  {end}  ", "<|endoftext| >", f"caf\u00e9{end}it's 12{end}"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {i: [*plain.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_output(spark, str(tmp_path)).collect()}
    start = 0
    for i, ids in expected.items():
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
