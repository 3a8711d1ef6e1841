import zlib
from collections import Counter

import numpy as np
import pytest

from lorekeep.llm import common, quality, toxicity


def corpus(spark, seed=0, n=500, mark="idiot"):
    """Documents of a few thousand made-up words; label 1 where some of the marked word's forms stand in them."""
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdefghij"), 5)) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        ws = list(r.choice(vocabulary, r.integers(20, 80)))
        y = int(r.random() < 0.4)
        for _ in range(4 * y):
            ws[int(r.integers(len(ws)))] = mark + str(r.choice(["", "s", "ic"]))
        docs.append((i, " ".join(ws), "en"))
        labels.append((i, y, y, "x"))
    extra = [(9001, None, "en"), (9002, "", "en"), (9003, "word " * 30_000 + mark, "en"), (0, docs[0][1], "en"), (None, "some text", "en")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, 1, "x"), (1, None, None, "x"), (3, labels[3][1], labels[3][1], "x")], "doc_id long, quality int, toxic int, text string")
    return d, lab, dict((i, y) for i, y, *_ in labels)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("module,cut", [(toxicity, 0.5), (quality, 0.3)])
def test_held_out_accuracy_and_columns(spark, module, cut):
    d, lab, truth = corpus(spark)
    got = module.score(d, lab).collect()
    assert len(got) == 505
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    assert auc([(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]) > 0.95
    assert len({r.score for r in got if r.doc_id == 0}) == 1 and len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_held_out_labels_are_not_learnt(spark, module):
    d, lab, _ = corpus(spark, 1, 200)
    other = lab.selectExpr("doc_id", *(f"CASE WHEN crc32(coalesce(cast(doc_id AS string), '')) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}" for c in ("quality", "toxic")))
    a, b = ({(r.doc_id, r.score) for r in module.score(d, x).collect()} for x in (lab, other))
    assert a == b


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_rows(spark, module):
    d, lab, _ = corpus(spark, 2, 40)
    assert {round(r.score, 9) for r in module.score(d, lab.limit(0)).collect()} == {0.5}
    assert module.score(d.limit(0), lab).count() == 0
    assert module.score(d, lab.where("toxic = 1")).where("score < 0.5").count() == 0


def test_kneser_ney_by_hand():
    m = toxicity.KneserNey([np.array([0, 1]), np.array([0, 2, 2])], [1, 0], {b"a": 0, b"b": 1, b"c": 2})
    # shared continuation counts: a after the start; b after a; c after a and after c; one more for each word and unknown ones
    shared = np.array([2, 2, 3, 1]) / 8
    p1 = [(max(n - 0.75, 0) + 0.75 * kinds * s) / total for n, s, kinds, total in [(1, shared[1], 2, 2)]][0]
    p0 = 0.75 * 2 * shared[1] / 3
    assert np.isclose(m.uni[m.vocab[b"b"]], np.log(p1 / p0), atol=1e-5)
    assert m.ratios(m.ids([[]])).tolist() == [[0.0, 0.0]]
    again = toxicity.KneserNey.load(m.dump())
    assert np.allclose(again.ratios(again.ids([[b"a", b"b", b"zz"]])), m.ratios([np.array([0, 1, 3])]))


def test_document_scores_as_brute_force():
    """Ratio and excess of whole documents, with probabilities from dictionaries of counts."""
    r = np.random.default_rng(6)
    texts = [[b"w%d" % x for x in r.zipf(1.4, r.integers(1, 40)) % 30] for _ in range(160)]
    labels = [int(x) for x in r.random(160) < 0.4]
    vocab: dict = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in t]) for t in texts]
    m = toxicity.KneserNey(ids, labels, vocab)
    count, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in zip(texts, labels):
        count[y].update(t)
        pairs[y].update(set(zip([None, *t], t)))
    follows = Counter(w for _, w in set(pairs[0]) | set(pairs[1]))
    every = sum(follows.values()) + len(vocab) + 1

    def p1(y, w):
        total = sum(count[y].values())
        return max(count[y][w] - toxicity.D1, 0) / total + toxicity.D1 * len(count[y]) / total * (follows[w] + 1) / every

    def p2(y, v, w):
        own = {k: c for k, c in pairs[y].items() if k[0] == v}
        if not own:
            return p1(y, w)
        total = sum(own.values())
        return max(own.get((v, w), 0) - toxicity.D2, 0) / total + sum(min(c, toxicity.D2) for c in own.values()) / total * p1(y, w)

    for t in [*texts[:40], [b"w1", b"unseen", b"w2"], [b"unseen"] * 3]:  # a word of no sample has the mass of one that never follows
        known = [w if w in vocab else b"?" for w in t]
        before = [None, *(w if w in vocab else None for w in t)]
        llr = [np.log(p2(1, v, w) / p2(0, v, w)) for v, w in zip(before, known)]
        assert np.allclose(m.ratios(m.ids([t]))[0], [np.mean(llr), np.mean(np.maximum(np.array(llr) - toxicity.MARGIN, 0))], atol=1e-4)


def test_expressions_of_ordinary_words_count():
    x, y, z = 0, 1, 2
    docs = [np.array([z, x, y, z])] * 10 + [np.array([z, y, x, z])] * 10
    m = toxicity.KneserNey(docs, [1] * 10 + [0] * 10, {b"x": x, b"y": y, b"z": z})
    toxic, ordinary = m.ratios([np.array([z, x, y, z]), np.array([z, y, x, z])])[:, 0]
    assert toxic > 0.5 and ordinary < -0.5
    once, often = (toxicity.KneserNey([np.array([x, y] * k), np.array([z])], [1, 0], {b"x": x, b"y": y, b"z": z}) for k in (1, 40))
    assert all(np.allclose(m.pair[m.keys == x * m.v + y], (m.back[x] + m.uni[y])) for m in (once, often))


def test_subword_features():
    h, n = quality.features(["ab", "abc", "ab"])
    assert n.tolist() == [1 + 3 + 2 + 1, 1 + 4 + 3 + 2, 7] and (h[:7] == h[-7:]).all()


def test_keeps_good(spark):
    d, lab, truth = corpus(spark, 3)
    kept = {r.doc_id for r in quality.keep_good(d, lab).collect()}
    assert None in kept and sum(truth[i] for i in truth if i in kept) > 0.95 * sum(truth.values())


def test_scores_are_means_over_whole_texts():
    r = np.random.default_rng(0)
    m = quality.Subwords(r.standard_normal(quality.BUCKETS + 1), 0.3)
    texts = ["a a a b", "", None, "c", "b b", "a", "x y x x x z"]
    for t, s in zip(texts, m.scores(texts)):
        ws = (t or "").split()
        h = quality.features(ws)[0] if ws else np.zeros(0, int)
        h = np.concatenate([h, np.full(quality.SAME * sum(a == b for a, b in zip(ws, ws[1:])), quality.BUCKETS)]).astype(int)
        z = (m.weights[h].mean() if len(h) else 0.0) + 0.3
        assert np.isclose(s, 1 / (1 + np.exp(-z)), atol=1e-5)


def test_fitting_apart():
    assert common._apart(lambda x: x * 100_000, b"ab") == b"ab" * 100_000
    with pytest.raises(RuntimeError, match="ZeroDivisionError"):
        common._apart(lambda x: x // 0, 1)
