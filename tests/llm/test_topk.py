import math

import numpy as np
import pytest

from lorekeep.llm import topk


def brute(qs, cs, k):
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(256 * x) for x in v]
    out = []
    for q, v in qs:
        if ok(v):
            s = sorted(((-sum(a * b for a, b in zip(ints(v), ints(w))), c) for c, w in cs if c != q and ok(w)))[:k]
            out += [(q, i + 1, c, -x) for i, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard,dims", [(50, 8), (8192, 3), (64, 1)])
def test_as_brute_force(spark, monkeypatch, shard, dims):
    monkeypatch.setattr(topk, "SHARD", shard)
    r = np.random.default_rng(dims)
    rows = [(i, [float(x) for x in np.round(r.normal(size=dims), 1)]) for i in range(400)]
    rows += [(400, None), (450, [float("nan")] * dims), (500, [None] * dims), (501, [float("inf")] * dims), (550, [0.0] * dims), (600, [1e9] * dims), (650, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score long").repartition(3)
    got = sorted(tuple(x) for x in topk.search(df.where("vec_id % 50 = 0"), df, 5).collect())
    assert got == brute([x for x in rows if x[0] % 50 == 0], rows, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_stops_early():
    r = np.random.default_rng(5)
    x = r.integers(-256, 256, (5000, 2))
    lists, walked = topk.Lists(np.arange(5000), x), []
    lists.f = type("Seen", (), {"__getitem__": lambda self, rows: walked.append(len(rows)) or x[rows].astype(float)})()
    lists.search(np.array([200, 3]), None, 5)
    assert sum(walked) < 1000
