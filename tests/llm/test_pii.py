"""Personal data: base matches against plain patterns, the field by held-out labels and by mentions that only links can find."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from voxspark.llm import pii
from voxspark.llm.queries import op11_personal_data

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
            if (True, all(int(p) <= 255 for p in m[0].split(".") if kind == 1), 12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15)[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_patterns_on_random_texts():
    rng = random.Random(1)
    for alphabet in ("ab.@-1", "0123.  ", "+1 ().-9", "@a.b@@c%.", "12 -45678", "0025.6 é"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+" * 400_000, "+1 " + " " * 400_000, "a@" * 200_000, "1 " * 200_000, "@" * 400_000, "a." * 200_000 + "@", "+1" * 200_000):
        began = time.perf_counter()
        pii.base_spans(text), pii.marked_tokens(text)
        assert time.perf_counter() - began < 5, text[:4]


@pytest.fixture(scope="module")
def field():
    return learned(range(400), 1)


def sample(numbers, seed):
    rng, texts = random.Random(seed), []
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for i in numbers:
        card = d(15)
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        mentions = [f"user{d(3)}.{i}@mail{d(1)}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{d(4)}"]
        texts.append(" _ ".join(rng.sample(mentions, rng.randint(1, 4)) + [f"version {d(1)}.{d(1)}.", f"in {d(4)}, x=\"{d(9)}ab\""]))
    return texts


def learned(numbers, seed):
    graph, labels = pii._training(sample(numbers, seed))
    return pii.fit_field(*graph.arrays(), labels)


def test_held_out_accuracy(field):
    graph, labels = pii._training(sample(range(1000, 1200), 2), seed=3)
    x, links, known = graph.arrays()
    p, open_ = field.marginals(x, links, known), known == 0
    found = np.where(p.max(1) >= 0.9, p.argmax(1), 0)
    wrong = (found != labels) & open_
    assert wrong.sum() <= 0.1 * open_.sum()
    assert ((found > 0) & (labels == 0) & open_).sum() <= 0.01 * open_.sum()
    # without links nothing tells a damaged mention from an unrelated number of its shape
    alone = field.marginals(x, links[:0], known)
    assert ((alone.argmax(1) != labels) & open_).sum() > 2 * wrong.sum()


def spans_of(field, *texts):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": list(texts)})
    return [[(pii.KINDS[k], t[a:b], base) for a, k, b, base in own] for t, own in zip(texts, pii._judged(batch, field, 0.9), strict=True)]


def test_distant_mentions_carry_labels(field):
    text = "Call +1 (974) 555-3436 now. " + "word " * 500 + "It is 974-555-3436, or (974) 555-3436."
    assert spans_of(field, text)[0] == [("phone", "+1 (974) 555-3436", True), ("phone", "974-555-3436", False), ("phone", "(974) 555-3436", False)]
    # the same numbers in another document, and numbers of that shape without a mention to agree with, stay
    assert spans_of(field, "Call +1 (974) 555-3436.", "It is 974-555-3436, or (974) 555-3436.", "4041.8949.7460.8795 3.0. 2024")[1:] == [[], []]


def test_belief_propagation_equals_enumeration_on_a_tree():
    rng = np.random.default_rng(4)
    field = pii.Field(rng.normal(size=(pii._N_FEATURES, 5)), rng.normal(size=(5, 5, 5)))
    x, links = rng.integers(0, 2, (4, pii._N_FEATURES)).astype(float), np.array([[0, 1, 0], [1, 2, 1], [1, 3, 2]])
    own, total = x @ field.weights, np.zeros((4, 5))
    for labels in np.ndindex(5, 5, 5, 5):
        w = np.exp(sum(own[i, k] for i, k in enumerate(labels)) + sum(field.pairs[t, labels[i], labels[j]] for i, j, t in links))
        for i, k in enumerate(labels):
            total[i, k] += w
    assert np.allclose(field.marginals(x, links, np.zeros(4, int), 200), total / total.sum(1, keepdims=True), atol=1e-2)


def test_op11_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_personal_data(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == x[1] for x in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert set(listed(base).split(",")) <= set(r["spans"].split(","))
        assert base or not r["spans"]
    assert sum(r["n_email"] for r in rows) and sum(r["n_phone"] for r in rows)


def test_odd_rows(spark, field):
    rows = [(1, None), (2, ""), (3, "no data"), (None, "a@b.c, é 1.2.3.4"), (4, "+1 (974) 555-3436 x 974-555-3436"), (4, "+1 (974) 555-3436 x 974-555-3436"), (5, "x" * 200_000 + " a@b.c " + "9 " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS spans", "'clash' AS kind", "'clash' AS h")
    got = pii.personal_spans(df, field).select("doc_id", pii.span_list(pii.F.col("spans")).alias("s")).collect()
    assert sorted((r["doc_id"] or 0, r["s"]) for r in got) == sorted([(1, ""), (2, ""), (3, ""), (0, "email:0:5,ip:9:16"), *[(4, "phone:0:17,phone:20:32")] * 2, (5, "email:200001:200006")])
    shown = {r["doc_id"]: r["text"] for r in pii.redact(df, field).collect()}
    assert shown[4] == "<phone> x <phone>" and shown[1] is None and shown[None] == "<email>, é <ip>"
    nothing = df.where("false")
    assert pii.personal_spans(nothing, pii.learn_field(nothing)).count() == 0
    assert pii.personal_spans(df.where("doc_id = 3"), pii.learn_field(df.where("doc_id = 3"))).count() == 1
