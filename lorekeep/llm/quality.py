"""Operator 6: quality classifier by supervised subword embeddings.

Hashed vectors of words and of character n-grams are averaged per document and go through a softmax over the labels;
vectors and output weights are learnt by stochastic gradient descent in numpy.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lorekeep.llm.common import crc_mod, fitted, labelled_sample, small_batches, trimmed

#: Labelled rows of each label that are learnt from, at most.
ROWS_EACH = 2500
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 17, 8, 6, 32, 0.3
SIZES = (2, 3, 4)
#: A word that equals the one before it also counts as so many features of one more vector, which learns repetition.
SAME = 8
#: Words whose summed features a worker keeps.
MEMO = 250_000


def features(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, word by word, and how many each word has: the word itself and its n-grams within < and >."""
    text = "".join(f"<{w}>" for w in ws)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in ws), np.int64, len(ws))
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(ws)), size)
    room = np.repeat(start + size, size) - np.arange(len(c))
    out, own = [], []
    mixed = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    place = (np.arange(len(c)) - np.repeat(start, size)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    whole = np.add.reduceat(mixed * (place * place + np.uint64(0xD1B54A32D192ED03)), start)
    out.append(whole), own.append(np.arange(len(ws)))
    for n in SIZES:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), np.uint64(n))
        for i in range(n):
            h = (h ^ mixed[at + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(32)
        out.append(h), own.append(owner[at])
    h, o = np.concatenate(out), np.concatenate(own)
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    order = np.argsort(o, kind="stable")
    return h[order].astype(np.int64), np.bincount(o, minlength=len(ws))


class Subwords:
    """Embeddings and softmax, reduced for scoring to one number a bucket: its vector times the difference of the outputs."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset, self.memo, self.kept = weights.astype(np.float32), float(offset), {}, np.zeros((0, 2))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, offset=self.offset)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Subwords:
        z = np.load(io.BytesIO(data))
        return cls(z["weights"], z["offset"])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [(t or "").split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.kept = {}, np.zeros((0, 2))
        if new := [w for w in dict.fromkeys(w for d in docs for w in d) if w not in self.memo]:
            h, n = features(new)
            sums = np.add.reduceat(self.weights[h].astype(np.float64), np.cumsum(n) - n)
            self.memo.update(zip(new, range(len(self.kept), len(self.kept) + len(new))))
            self.kept = np.concatenate([self.kept, np.stack([sums, n], 1)])
        sizes = np.array([len(d) for d in docs])
        flat = np.fromiter((self.memo[w] for d in docs for w in d), np.int64, sizes.sum())
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(self.kept[flat], 0)])
        ends = np.cumsum(sizes)
        x = total[ends] - total[ends - sizes]
        same = np.zeros(len(flat) + 1)
        same[1:-1] = flat[1:] == flat[:-1]
        same[ends - sizes] = 0
        repeats = SAME * np.diff(np.concatenate([[0.0], np.cumsum(same)])[np.stack([ends - sizes, ends], 1)], axis=1)[:, 0]
        x += repeats[:, None] * [[float(self.weights[BUCKETS]), 1.0]]
        return 1 / (1 + np.exp(-np.clip(x[:, 0] / np.maximum(x[:, 1], 1) + self.offset, -30, 30)))


def fit(sample: Iterable[tuple[str, int]], seed: int = 7, same: int = SAME) -> Subwords:
    """Stochastic gradient descent with a step size for each bucket that shrinks with its past gradients."""
    docs, labels = [], []
    for text, label in sample:
        ws = text.split()
        h = features(ws)[0] if ws else np.zeros(0, np.int64)
        h = np.concatenate([h, np.full(same * sum(a == b for a, b in zip(ws, ws[1:])), BUCKETS)])
        keys, c = np.unique(h, return_counts=True)
        docs.append((keys, (c / max(len(h), 1)).astype(np.float32)))
        labels.append(label)
    y = np.array(labels, np.int64)
    if not 0 < y.sum() < len(y):
        return Subwords(np.zeros(BUCKETS + 1), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rng = np.random.default_rng(seed)
    E = rng.uniform(-0.5, 0.5, (BUCKETS + 1, DIM)).astype(np.float32) / DIM
    W, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    past_E, past_W, past_b = np.full(BUCKETS + 1, 1e-8, np.float32), np.full_like(W, 1e-8), np.full_like(b, 1e-8)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for k in range(0, len(order), BATCH):
            ids = order[k : k + BATCH]
            rows = [docs[i] for i in ids]
            n = np.array([len(r[0]) for r in rows])
            at, weight = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            owner = np.repeat(np.arange(len(ids)), n)
            mean = np.stack([np.bincount(owner, weight * E[at, d], len(ids)) for d in range(DIM)], 1)
            z = mean @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ids)), y[ids]] -= 1
            p /= len(ids)
            uniq, inv = np.unique(at, return_inverse=True)
            back = p @ W.T
            g = np.stack([np.bincount(inv, weight * back[owner, d], len(uniq)) for d in range(DIM)], 1)
            past_E[uniq] += (g * g).mean(1)
            E[uniq] -= (RATE / np.sqrt(past_E[uniq]))[:, None] * g * 0.1
            gW, gb = mean.T @ p, p.sum(0)
            past_W += gW * gW
            past_b += gb * gb
            W -= (RATE / np.sqrt(past_W) * gW).astype(np.float32)
            b -= (RATE / np.sqrt(past_b) * gb).astype(np.float32)
    return Subwords(E @ (W[:, 1] - W[:, 0]), b[1] - b[0])


def _model(documents: DataFrame, labels: DataFrame, label: str, rows_each: int):
    """The fitted model as a broadcast of its bytes."""
    small_batches(documents.sparkSession)
    sample = labelled_sample(documents, labels, label, {0: rows_each, 1: rows_each})
    return documents.sparkSession.sparkContext.broadcast(fitted(sample, lambda rows: fit(rows).dump()))


def score(documents: DataFrame, labels: DataFrame, label: str = "quality", rows_each: int = ROWS_EACH, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    Learns from at most rows_each labelled rows of each label outside the held-out fifth. Null and empty texts get the
    softmax of the offsets alone; a null doc_id counts as empty text in the fold; repeated rows are scored each; extra
    columns are ignored. Without labels every score is 0.5.
    """
    sent = _model(documents, labels, label, rows_each)

    def run(batches):
        own = Subwords.load(sent.value)
        for b in batches:
            s = own.scores(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame, label: str = "quality", rows_each: int = ROWS_EACH, threshold: float = 0.3) -> DataFrame:
    """The rows of documents that score() does not reject, with their columns; each row is judged by itself, in the pass that scores it."""
    sent, at = _model(documents, labels, label, rows_each), documents.columns.index("text")

    def run(batches):
        own = Subwords.load(sent.value)
        for b in batches:
            yield b.filter(pa.array(own.scores(b.column(at).to_pylist()) >= threshold, pa.bool_()))

    return documents.mapInArrow(lambda batches: trimmed(run(batches)), documents.schema)
