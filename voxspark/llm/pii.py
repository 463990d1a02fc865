"""Personal data by patterns and by a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  Mentions that they
miss (a phone number without its prefix, a card written with dots, an address cut off) are found by
a field over the tokens of a document that hold a digit or ``@``: neighbouring tokens share a potential,
and so do distant ones that are repeated or similar (the same last seven digits, the same
digits with the token behind, the same local part, the same first three of four numbers).
Loopy belief propagation carries a label from the mention that a pattern finds to the
others, and a token counts where its label's probability reaches a threshold.  Occurrences are linked
one to the next, so links grow with the tokens, however often one is repeated.

The weights are fitted by pseudo-likelihood on at most `sample` documents (a documented bound),
labelled by the base patterns and by mentions damaged on purpose, with unrelated ones of the same shape
as counterexamples.  Texts are judged whole and in linear time.

Cases: null text counts as empty; documents without a mention give no spans; repeated rows are judged each
on its own; without any base match in the sample the field adds nothing; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import steps

KINDS = ("email", "ip", "card", "phone")
_WHITE = " \t\n\v\f\r"
_OUTER = ".,;:!?\"'[]{}<>"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_GAP = re.compile(r"[ \t-\r]")
_DIGITS = re.compile(r"[^0-9]+")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and apart for each kind; sorted by start, then kind.

    The patterns are searched in a form that takes linear time: an address from its @, numbers from the start of their digits.
    """
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            end = m.end()
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def marked_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens between white space that hold a digit or @."""
    out, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() >= end:
            start = max(end, *(text.rfind(c, end, m.start()) + 1 for c in _WHITE))
            gap = _GAP.search(text, m.end())
            end = gap.start() if gap else len(text)
            out.append((start, end))
    return out


_N_FEATURES = 24


def _features(token: str) -> list[int]:
    """Places of the features that a token has."""
    bare = token.strip(".,;:!?\"'()[]{}<>")
    digits = _DIGITS.sub("", bare)
    n, groups = len(digits), re.split(r"[.-]", bare)
    numeric = all(g.isdigit() and g.isascii() for g in groups)
    sizes = (1, 3, 4, 5, 7, 8, 12, 20)
    out = [0, 1 + sum(n >= s for s in sizes[1:])]
    tests = ("@" in bare, bool(_DOMAIN.search(bare)), token.startswith("+"), token.startswith("+") and n <= 3, numeric and len(groups) == 1, numeric and len(groups) > 1,
             numeric and len(groups) == 4, numeric and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), 12 <= n <= 19 and luhn(digits), "(" in token and ")" in token,
             "-" in bare, "." in bare, any(c.isalpha() for c in bare), "=" in token or '"' in token, len(bare) >= 20)
    return out + [9 + k for k, x in enumerate(tests) if x]


def _keys(token: str, behind: str | None) -> Iterator[tuple[int, str]]:
    """(type of link, key): tokens of one document with the same key are linked."""
    digits = _DIGITS.sub("", token)
    if len(digits) >= 7:
        yield 1, digits[-7:]
    if behind is not None and digits and (more := _DIGITS.sub("", behind)) and len(digits) + len(more) >= 4:
        yield 2, f"{digits} {more}"
    local, at, _ = token.partition("@")
    if at and len(local) >= 3:
        yield 3, local.strip("\"'(<[").lower()
    groups = _DIGITS.sub(".", token).strip(".").split(".")
    if len(groups) == 4:
        yield 4, ".".join(groups[:3])


_LINKS = 5  # the chain, and four types of skips


class Graph:
    """Tokens of many documents as one graph: features and typed links."""

    def __init__(self) -> None:
        self.places: list[tuple[int, int, int]] = []  # document, start, end
        self.rows: list[int] = []
        self.columns: list[int] = []
        self.links: list[tuple[int, int, int]] = []
        self.known: list[int] = []  # labels given by base matches, 0: open

    def add(self, doc: int, text: str, spans: list[Span]) -> None:
        """The marked tokens of a text; those in base matches have their labels."""
        tokens = marked_tokens(text)
        words, ends = [text[a:b] for a, b in tokens], [b for _, b in tokens]
        known = [0] * len(tokens)
        for a, kind, b in spans:
            k = bisect_right(ends, a)
            while k < len(tokens) and tokens[k][0] < b:
                known[k] = known[k] or kind + 1
                k += 1
        self.known += known
        last: dict[tuple[int, str], int] = {}
        for k, ((a, b), word) in enumerate(zip(tokens, words, strict=True)):
            i = len(self.places)
            self.places.append((doc, a, b))
            found = _features(word)
            self.rows += [i] * len(found)
            self.columns += found
            joined = k + 1 < len(tokens) and text[b:tokens[k + 1][0]].strip(_WHITE) == ""
            if joined:
                self.links.append((i, i + 1, 0))
            for key in _keys(word, words[k + 1] if joined else None):
                if key in last:
                    self.links.append((last[key], i, key[0]))
                last[key] = i

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.zeros((len(self.places), _N_FEATURES), np.float64)
        x[self.rows, self.columns] = 1
        return x, np.array(self.links, np.int64).reshape(-1, 3), np.array(self.known, np.int64)


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


@dataclass
class Field:
    """Weights of the features, and a potential of label pairs for each type of link."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, x: np.ndarray, links: np.ndarray, known: np.ndarray, rounds: int = 50) -> np.ndarray:
        """Probabilities of labels by loopy belief propagation, all links at once with damping; known labels are held."""
        own = x @ self.weights
        held = np.flatnonzero(known)
        own[held] = -50
        own[held, known[held]] = 0
        if len(links):
            i, j, kind = links.T
            to_j, to_i = np.zeros((2, len(links), own.shape[1]))
            forth, to = self.pairs[kind], np.concatenate((j, i))
            for _ in range(rounds):
                belief = own.copy()
                np.add.at(belief, to, np.concatenate((to_j, to_i)))
                new_j = _normal(np.logaddexp.reduce((belief[i] - to_i)[:, :, None] + forth, axis=1))
                new_i = _normal(np.logaddexp.reduce((belief[j] - to_j)[:, None, :] + forth, axis=2))
                change = max(np.abs(new_j - to_j).max(), np.abs(new_i - to_i).max())
                to_j, to_i = (to_j + new_j) / 2, (to_i + new_i) / 2
                if change < 1e-3:
                    break
            np.add.at(own, to, np.concatenate((to_j, to_i)))
        return np.exp(_normal(own))


def fit_field(x: np.ndarray, links: np.ndarray, known: np.ndarray, labels: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> Field:
    """Weights by pseudo-likelihood: each open token's label given the labels of the tokens linked with it."""
    n_labels = len(KINDS) + 1
    gold = np.eye(n_labels)[labels]
    left, right = np.zeros((2, len(x), _LINKS, n_labels))  # labels of the tokens linked from each side
    i, j, kind = links.T
    np.add.at(left, (j, kind), gold[i])
    np.add.at(right, (i, kind), gold[j])
    left, right = left.reshape(len(x), _LINKS * n_labels), right.reshape(len(x), _LINKS * n_labels)
    w = [np.zeros((x.shape[1], n_labels)), np.zeros((_LINKS, n_labels, n_labels))]
    speed, size = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, rounds + 1):
        turned = w[1].transpose(0, 2, 1).reshape(-1, n_labels)
        logits = x @ w[0] + left @ w[1].reshape(-1, n_labels) + right @ turned
        off = (np.exp(_normal(logits)) - gold) * ((known == 0) / max(1, (known == 0).sum()))[:, None]
        pair = (left.T @ off).reshape(w[1].shape) + (right.T @ off).reshape(w[1].shape).transpose(0, 2, 1)
        pair[1:] = (pair[1:] + pair[1:].transpose(0, 2, 1)) / 2  # skips have no direction
        for k, slope in enumerate((x.T @ off, pair)):
            slope = slope + decay * w[k]
            speed[k] = 0.9 * speed[k] + 0.1 * slope
            size[k] = 0.999 * size[k] + 0.001 * slope ** 2
            w[k] = w[k] - 0.1 * (speed[k] / (1 - 0.9 ** t)) / (np.sqrt(size[k] / (1 - 0.999 ** t)) + 1e-8)
    return Field(*w)


def damaged_mention(mention: str, kind: int, rng: random.Random) -> str:
    """The mention in a form that no base pattern finds."""
    if kind == 0:
        return mention[:mention.index(".", mention.index("@"))]
    if kind in (1, 2):
        digits = mention if kind == 1 else _DIGITS.sub("", mention)
        return mention.replace(".", rng.choice("-_")) if kind == 1 else ".".join(digits[k:k + 4] for k in range(0, len(digits), 4))
    digits = _DIGITS.sub("", mention)
    return rng.choice([mention.lstrip("+0123456789").lstrip() or digits, f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"])


def _training(texts: list[str], seed: int = 13) -> tuple[Graph, np.ndarray]:
    """Sampled texts with damaged mentions of their own (labelled) and of others (not labelled) behind them."""
    rng, graph, labels = random.Random(seed), Graph(), []
    for doc, text in enumerate(texts):
        spans = base_spans(text)
        gold = [(a, b, k) for a, k, b in spans]
        for a, kind, b in rng.sample(spans, min(3, len(spans))):
            for own in (True, False):
                mention = text[a:b] if own else re.sub("[0-9]", lambda _: str(rng.randint(1, 9)), text[a:b][::-1] if kind == 2 else text[a:b])
                mention = damaged_mention(mention if own or kind else f"x{rng.randint(0, 9999)}{mention}", kind, rng)
                text += " _ "
                if own:
                    gold.append((len(text), len(text) + len(mention), kind))
                text += mention
        before = len(graph.places)
        graph.add(doc, text, base_spans(text))
        for _, a, b in graph.places[before:]:
            labels.append(next((k + 1 for s, e, k in gold if s < b and a < e), 0))
    return graph, np.array(labels, np.int64)


def _skeletons(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Of each text with marked tokens these alone, _ for what stands between, for training."""
    for batch in batches:
        hashes, texts = [], []
        for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text, out, at = t.as_py() or "", [], 0
            for a, b in marked_tokens(text):
                out.append(text[a:b] if text[at:a].strip(_WHITE) == "" else "_ " + text[a:b])
                at = b
                if len(out) > most // 4:
                    break
            if out:
                hashes.append(h)
                texts.append(" ".join(out)[:most])
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], ["h", "skeleton"])


def learn_field(docs: DataFrame, sample: int = 4000) -> Field:
    """The field fitted on at most `sample` documents with marked tokens, chosen by a hash of their ids.

    Of a sampled document up to 2000 code points of marked tokens take part.
    """
    hashed = docs.select(F.xxhash64("doc_id").alias("h"), F.col("text"))
    share = min(1.0, 20 * sample / max(1, docs.count()))
    if share < 1:
        hashed = hashed.where(F.col("h") < int(-2 ** 63 + share * 2 ** 64))
    rows = hashed.mapInArrow(_skeletons, "h long, skeleton string").orderBy("h", "skeleton").limit(sample).collect()
    graph, labels = _training([r["skeleton"] for r in rows])
    return fit_field(*graph.arrays(), labels)


def _added(graph: Graph, field: Field, covered: dict[int, tuple[list[int], list[int]]], texts: dict[int, str], threshold: float) -> dict[int, list[Span]]:
    """Spans of labelled tokens that touch no base span; neighbours of one label make one span."""
    out: dict[int, list[Span]] = {}
    x, links, known = graph.arrays()
    p = field.marginals(x, links, known)
    label = np.where((known == 0) & (p.max(1) >= threshold), p.argmax(1), 0)
    joined = {int(b) for a, b, k in links if k == 0}
    runs: list[list[int]] = []
    for i in np.flatnonzero(label).tolist():
        if runs and runs[-1][-1] == i - 1 and i in joined and label[i - 1] == label[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    for run in runs:
        (doc, start, _), (_, _, end) = graph.places[run[0]], graph.places[run[-1]]
        text, (starts, ends) = texts[doc], covered[doc]
        while start < end and text[start] in _OUTER:
            start += 1
        while end > start and text[end - 1] in _OUTER:
            end -= 1
        k = bisect_right(ends, start)  # the first stretch of base spans that ends behind the start
        if start < end and not (k < len(ends) and starts[k] < end):
            out.setdefault(doc, []).append((start, int(label[run[0]]) - 1, end))
    return out


def _stretches(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts of a text that sorted spans cover together."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _judged(batch: pa.RecordBatch, field: Field, threshold: float) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of the spans of every row."""
    graph, base, texts = Graph(), {}, {}
    for doc, t in enumerate(batch.column("text")):
        text = t.as_py() or ""
        if _MARK.search(text):
            base[doc], texts[doc] = base_spans(text), text
            graph.add(doc, text, base[doc])
    added = _added(graph, field, {d: _stretches(b) for d, b in base.items()}, texts, threshold) if graph.places else {}
    return [sorted([(a, k, b, True) for a, k, b in base.get(d, ())] + [(a, k, b, False) for a, k, b in added.get(d, ())]) for d in range(batch.num_rows)]


_SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def personal_spans(docs: DataFrame, field: Field, threshold: float = 0.9) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every text by start, then kind; places count code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = _judged(batch, field, threshold)
            flat = [r for own in rows for r in own]
            parts = pa.StructArray.from_arrays([pa.array([KINDS[r[1]] for r in flat], pa.string()), pa.array([r[0] for r in flat], pa.int32()), pa.array([r[2] for r in flat], pa.int32()), pa.array([r[3] for r in flat], pa.bool_())], ["kind", "start", "end", "base"])
            offsets = np.concatenate(([0], np.cumsum([len(own) for own in rows]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), parts)], ["doc_id", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, {_SPANS}")


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, field: Field, threshold: float = 0.9) -> DataFrame:
    """The texts of docs (doc_id, text) with <kind> in the place of each span; of spans that overlap the first one counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for text, spans in zip(batch.column("text"), _judged(batch, field, threshold), strict=True):
                t, at, parts = text.as_py(), 0, []
                for start, kind, end, _ in spans:
                    if start >= at:
                        parts += [t[at:start], f"<{KINDS[kind]}>"]
                        at = end
                out.append(t if not parts else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, text string")
