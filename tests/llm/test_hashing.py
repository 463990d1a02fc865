import base64

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from voxspark.llm import arrow, bpe, hashing, jaccard_join, quality, search, token_output

#: Two words of 1024 letters that polynomial hashes with an odd base modulo 2**64 take for one.
ODD = ["".join("ac"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]


def test_structured_words_stay_apart():
    one, two = (f"x {w} y z w v u t s r" for w in ODD)
    words, at = hashing.words_of([one.encode(), two.encode()], lower=True)
    assert len(np.unique(words)) == 11 and np.diff(at).tolist() == [10, 10]
    a, b = hashing.shingle_sets([one.encode(), two.encode()])
    assert len(np.intersect1d(a, b)) == 4  # of 6, those without the word
    assert jaccard_join._digest(a) != jaccard_join._digest(b)
    repeated = " ".join([ODD[0], "b c d e", ODD[1], "b c d e"])
    assert quality._repeats([repeated.encode()])["n_repeat_words"].tolist() == [0]
    term, text, tf, n = search._term_counts([ODD[0].encode(), ODD[1].encode()])
    assert len(np.unique(term)) == 2 and n.tolist() == [1, 1]


def test_structured_units_have_their_own_ids():
    texts = [f"x {w} y" for w in ODD]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    flat, at = bpe.UnitCoder(bpe.ByteBpe(path, public_tokenizers.PATTERN).encode_words).encode([t.encode() for t in texts])
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [enc.encode_ordinary(t) for t in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    flat, at = token_output._coder(path).encode([t.encode() for t in texts])
    library = Tokenizer.from_file(path)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_words_count_each_byte():
    words = ["a" * n for n in (1, 127, 128, 129, 300, 3000, 3001)] + ["a" * 200 + "b" + "a" * 99, "a" * 299 + "b"]
    hashes, _ = hashing.words_of([" ".join(words).encode()], lower=True)
    assert len(np.unique(hashes)) == len(words)
    again, _ = hashing.words_of([("  " + w + "\t").encode() for w in words], lower=True)
    assert (hashes == again).all()


def test_steps_follow_real_sizes():
    texts = ["a" * 10] * 5 + ["b" * 1000] + [None, "c" * 30, "c" * 30, "c" * 50]
    got = [b.column("text").to_pylist() for b in arrow.steps([pa.RecordBatch.from_pydict({"text": texts})], size=100)]
    assert sum(got, []) == texts
    assert all(len(x) == 1 or sum(len(t or "") for t in x) <= 100 for x in got)
