"""Operator 2: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary text, back off to class unigrams and these
to one shared distribution of continuation counts, so a rare expression weighs little in either class. A document's
score is a logistic function of its log-likelihood ratio a word, in whole and of strong expressions alone.
"""

from __future__ import annotations

import io
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, fitted, labelled_sample, small_batches

#: Labelled rows that are learnt from, at most.
TOXIC_ROWS, ORDINARY_ROWS = 2000, 4000
#: Discounts of word counts, and of the number of documents with a bigram: phrases of up to three documents are left to their words.
D1, D2 = 0.75, 3.0
#: Expressions whose log ratio exceeds this also count on their own, as an excess over it.
MARGIN = 2.5


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class KneserNey:
    """Log-likelihood ratio of toxic to ordinary text, as tables over known words and bigrams."""

    def __init__(self, ids: list[np.ndarray], labels: list[int], vocab: dict[bytes, int]):
        """ids: of the words of each document, by vocab; words of vocab that no document has count as unknown ones do."""
        self.vocab, n = vocab, len(vocab)
        self.v = n + 1  # id n: start of a text, and unknown words
        uni, pairs = np.zeros((2, n + 1)), []
        for k in (0, 1):
            own = [x for x, y in zip(ids, labels) if y == k and len(x)]
            flat = np.concatenate([np.zeros(0, np.int64), *own])
            uni[k] = np.bincount(flat, minlength=n + 1)
            # once a document, so that what one repeats doesn't count as usage of the class
            keys = [np.unique(np.concatenate([[n], x[:-1]]) * self.v + x) for x in own]
            pairs.append(np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True))
        every = np.union1d(pairs[0][0], pairs[1][0])
        shared = np.bincount(every % self.v, minlength=n + 1) + 1.0  # continuation counts of both classes
        shared /= shared.sum()
        logp1, back, seen = [], [], []
        for k in (0, 1):
            total = max(uni[k].sum(), 1.0)
            p1 = np.maximum(uni[k] - D1, 0) / total + (D1 * (uni[k] > 0).sum() / total if uni[k].any() else 1.0) * shared
            keys, c = pairs[k]
            context = np.bincount(keys // self.v, weights=c, minlength=n + 1)
            lam = np.where(context > 0, np.bincount(keys // self.v, weights=np.minimum(c, D2), minlength=n + 1) / np.maximum(context, 1), 1.0)
            at, into = np.searchsorted(keys, every), np.zeros(len(every))
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == every) if len(keys) else np.zeros(len(every), bool)
            into[hit] = c[at[hit]]
            v, w = every // self.v, every % self.v
            p2 = np.maximum(into - D2, 0) / np.maximum(context[v], 1) + lam[v] * p1[w]
            logp1.append(np.log(p1)), back.append(np.log(lam)), seen.append(np.log(p2))
        self.uni = (logp1[1] - logp1[0]).astype(np.float32)
        self.back = (back[1] - back[0]).astype(np.float32)
        self.keys, self.pair = every, (seen[1] - seen[0]).astype(np.float32)
        self.w = np.zeros(3)

    def ids(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        n, get = self.v - 1, self.vocab.get
        return [np.fromiter((get(w, n) for w in d), np.int32, len(d)) for d in docs]

    def ratios(self, docs: list[np.ndarray]) -> np.ndarray:
        """For each document the log-likelihood ratio and the excess of its strong expressions, both a word; 0 without words."""
        n = self.v - 1
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
        if not len(flat):
            return np.zeros((len(docs), 2))
        before = np.empty_like(flat)
        before[1:] = flat[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts[sizes > 0]] = n
        key = before * self.v + flat
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), np.int64)
        llr = np.where(self.keys[at] == key, self.pair[at], self.back[before] + self.uni[flat]) if len(self.keys) else self.back[before] + self.uni[flat]
        both = np.stack([llr, np.maximum(llr - MARGIN, 0)], 1)
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(both, 0, dtype=np.float64)])
        return (total[starts + sizes] - total[starts]) / np.maximum(sizes, 1)[:, None]

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.ratios(self.ids(docs)) @ self.w[:2] + self.w[2], -30, 30)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, words=np.frombuffer(b"\n".join(self.vocab), np.uint8), v=self.v, uni=self.uni, back=self.back, keys=self.keys, pair=self.pair, w=self.w)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> KneserNey:
        z, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        ws = z["words"].tobytes().split(b"\n") if z["v"] > 1 else []
        self.vocab = dict(zip(ws, range(len(ws))))
        self.v, self.uni, self.back, self.keys, self.pair = int(z["v"]), z["uni"], z["back"], z["keys"], z["pair"]
        self.w = z["w"]
        return self


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of x, then the offset, by Newton's method on standardised columns with a slight ridge."""
    mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    m, w = np.column_stack([(x - mean) / sd, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (m @ w)).sum() + 0.01 * w @ w
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 0.02 * np.eye(len(w)), m.T @ (y - p) - 0.02 * w)
        while loss(w + step) > loss(w) and abs(step).max() > 1e-9:
            step /= 2
        w += step
        if abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


def fit(sample: Iterable[tuple[str, int]]) -> KneserNey:
    """Counts of three quarters of the sample calibrate on the other quarter; the counts of all are then kept.

    A sample without both labels gives a model that scores all texts alike.
    """
    labels, vocab, ids = [], {}, []
    for t, k in sample:
        ids.append(np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], np.int32))
        labels.append(k)
    y = np.array(labels, float)
    fold, w = np.arange(len(y)) % 4 == 0, np.zeros(3)
    if 0 < y[fold].sum() < fold.sum() and 0 < y[~fold].sum() < (~fold).sum():
        part = KneserNey([d for d, f in zip(ids, fold) if not f], [int(k) for k in y[~fold]], vocab)
        w = logistic(part.ratios([d for d, f in zip(ids, fold) if f]), y[fold])
        del part
    else:
        w[2] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    model = KneserNey(ids, [int(k) for k in y], vocab)
    model.w = w
    return model


def score(documents: DataFrame, labels: DataFrame, label: str = "toxic", toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents.

    Learns from at most toxic_rows and ordinary_rows labelled rows outside the held-out fifth. Null and empty texts get
    the score of a ratio of 0; a null doc_id counts as empty text in the fold; repeated rows are scored each; extra
    columns are ignored. Without labels every score is 0.5.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sample = labelled_sample(documents, labels, label, {1: toxic_rows, 0: ordinary_rows})
    sent = spark.sparkContext.broadcast(fitted(sample, lambda rows: fit(rows).dump()))

    def run(batches):
        model = KneserNey.load(sent.value)
        for b in batches:
            s = model.scores([words(t) for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
