import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm import lm


@pytest.mark.parametrize("kept,hot", [(20, 40), (8192, 1 << 18)])
def test_counts_and_base_as_brute_force(spark, kept, hot):
    r = np.random.default_rng(0)
    rows = [(i, " ".join(f"W{int(x)}" for x in r.zipf(1.5, r.integers(0, 60)) % 500)) for i in range(150)] + [(500, None), (501, ""), (502, "unseen " * 3000), (3, "w1 w1"), (None, "w1\x0bw2\x1cw3")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(4)
    toks = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    N, V = sum(c.values()), len(c)
    want = sorted((str(d), h, len(t), sum(c[w] > 0 for w in t), N, round(sum(math.log10((c[w] + 1) / (N + V + 1)) for w in t), 6)) for (d, _), t, h in zip(rows, toks, held))
    got = lm.score(df, kept=kept, hot_words=hot, share=2).collect()
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    assert all(math.isfinite(x.score) and x.score < 0 for x in got)
    again = {(x.doc_id, x.n_tokens): x.score for x in lm.score(df, kept=kept, hot_words=hot, share=2, rounds=0).collect()}
    assert all(abs(again[x.doc_id, x.n_tokens] - x.base_score) < 1e-3 + 1e-5 * abs(x.base_score) for x in got)  # untrained: the smoothed unigrams


def test_distribution_sums_to_one_and_windows_carry_state():
    r = np.random.default_rng(1)
    m = lm.Gru(r.integers(1, 50, 300).astype(float), r)
    docs = [np.append(r.integers(1, 300, n), 0).astype(np.int32) for n in (0, 1, 5, 63, 64, 65, 200, 700)]
    m.train(np.concatenate(docs * 20))
    h = np.tanh(r.standard_normal((1, lm.HIDDEN))).astype(np.float32)
    assert abs(np.exp(m.outputs(np.repeat(h, 300, 0), np.arange(300))[0]).sum() - 1) < 1e-4

    def plain(doc):
        h, x, total, H = np.zeros(lm.HIDDEN), 0, 0.0, lm.HIDDEN
        sig = lambda a: 1 / (1 + np.exp(-a))
        for y in doc:
            e, u = m.p["E"][x] @ m.p["Wx"] + m.p["b"], h @ m.p["U"]
            z, k = sig(e[:H] + u[:H]), sig(e[H : 2 * H] + u[H : 2 * H])
            h = z * h + (1 - z) * np.tanh(e[2 * H :] + k * u[2 * H :])
            total, x = total + m.outputs(h[None].astype(np.float32), np.array([y]))[0][0], y
        return total

    assert np.allclose(m.score(docs), [plain(d) for d in docs], rtol=1e-3, atol=1e-2)


def test_learns():
    r = np.random.default_rng(2)
    docs = [np.append((np.arange(30) + r.integers(0, 6)) % 6 + 2, 0).astype(np.int32) for _ in range(400)]
    m = lm.Gru(np.full(8, 100.0), r)
    before = m.score(docs[:20]).sum()
    for _ in range(4):
        m.train(np.concatenate(docs))
    assert m.score(docs[:20]).sum() > 0.7 * before


def test_gradient():
    r = np.random.default_rng(3)
    m = lm.Gru(r.integers(1, 9, 40).astype(float), r)
    m.p["C"] += r.standard_normal(m.p["C"].shape).astype(np.float32)
    m.p["O"] += r.standard_normal(m.p["O"].shape).astype(np.float32)
    h, y = r.standard_normal((3, lm.HIDDEN)).astype(np.float32), np.array([1, 7, 30])
    g = {"C": np.zeros_like(m.p["C"]), "c": np.zeros_like(m.p["c"]), "O": np.zeros_like(m.p["O"]), "o": np.zeros_like(m.p["o"])}
    _, dh = m.outputs(h, y, g, np.ones(3, np.float32))
    for k in range(4):
        e = np.zeros_like(h)
        e[1, k] = 1e-2
        assert abs(-(m.outputs(h + e, y)[0].sum() - m.outputs(h - e, y)[0].sum()) / 2e-2 - dh[1, k]) < 1e-2


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lm.score(df.limit(0)).count() == 0


def test_all_training_documents_are_trained_on(spark):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("ab cd ef gh ij kl".split()) for _ in range(80))) for i in range(60)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    far = {x.doc_id for x in make(docs).where("pmod(xxhash64(cast(doc_id AS string)), 24) > 1 AND crc32(cast(doc_id AS string)) % 7 <> 2").collect()}
    # the same counts, so that only gradient steps can tell the corpora apart
    other = [(i, " ".join(sorted(t.split())) if i in far else t) for i, t in docs]
    a, b = ({x.doc_id: x.score for x in lm.score(make(rows)).where("held_out").collect()} for rows in (docs, other))
    assert a and all(abs(a[i] - b[i]) > 1e-6 for i in a)


def test_words_as_in_python():
    r = random.Random(6)
    texts = ["".join(r.choice("aZ éÉİ\x00\x1c\x1f\x85\xa0\u3000\t\n\x0b\x0c\r Q") for _ in range(r.randrange(25))) for _ in range(3000)] + [None, "", " ", "a", " a "]
    want = [(t or "").encode().lower().split() for t in texts]
    words, sizes = lm.words_of(pa.array(texts))
    assert words.to_pylist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_sigmoid():
    x = np.array([-1e30, -200, -5, 0, 3, 200, 1e30], np.float32)
    want = [0, 0, 1 / (1 + math.exp(5)), 0.5, 1 / (1 + math.exp(-3)), 1, 1]
    with np.errstate(all="raise", under="ignore"):
        lm.sigmoid(x)
    assert np.allclose(x, want, atol=1e-6)


def test_words_are_counted_in_half_of_pythons_time():
    r = random.Random(7)
    texts = [" ".join(f"W{int(r.paretovariate(0.5)) % 200_000}" for _ in range(400)) for _ in range(1000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 250])], names=["text"]) for k in range(0, 1000, 250)]

    def plain():
        seen = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(t.encode().lower().split())
        return seen

    def counted():
        (group,) = lm.groups(batches, 0)
        return lm.counts_of(group)

    took = [[], []]
    for _ in range(5):
        for f, own in zip((plain, counted), took):
            began = time.thread_time()
            got = f()
            own.append(time.thread_time() - began)
    assert dict(zip(got.column("word").to_pylist(), got.column("n").to_pylist())) == plain()
    assert min(took[1]) < 0.7 * min(took[0])


def test_steps_and_outputs_as_written_out():
    """Ids of any order and classes of one word; the logarithms as of plain softmaxes, before and after training."""
    r = np.random.default_rng(8)
    m = lm.Gru(np.array([900.0, 5, 700, 3, 3, 2, 40, 1, 1, 9]), r)
    docs = [np.append(r.integers(1, 10, 50), 0).astype(np.uint16) for _ in range(60)]
    for _ in range(2):
        h, y = np.tanh(r.standard_normal((50, lm.HIDDEN))).astype(np.float32), r.integers(0, 10, 50)
        c, o = h @ m.p["C"] + m.p["c"], h @ m.p["O"].T + m.p["o"]
        same = np.repeat(np.arange(m.n_classes), np.diff(m.edges))
        want = [c[i, same[k]] - np.log(np.exp(c[i]).sum()) + o[i, k] - np.log(np.exp(o[i, same == same[k]]).sum()) for i, k in enumerate(m.place[y])]
        for safe in (False, True):
            assert np.allclose(m.outputs(h, y, safe=safe)[0], want, atol=1e-4)
        m.train(np.concatenate(docs).astype(np.int32))
