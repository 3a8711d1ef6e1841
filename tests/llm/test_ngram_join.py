import random

import numpy as np
import pytest

from lorekeep.llm import ngram_join as N


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n):
    r = random.Random(seed)
    base = [[f"w{r.randrange(300)}" for _ in range(r.choice((1, 3, 4, 6, 9, 20, 60, 200)))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5, 8))):
            k = r.randrange(len(w))
            w[k : k + r.choice((0, 1, 1))] = r.choice(([], [f"e{r.randrange(40)}"]))
            w = w or ["x"]
        rows.append((i * 3 + 1, " ".join(w).replace("w1", "W1")))
    return rows + [(2, None), (5, ""), (8, " \n"), (11, "A b C"), (14, "a B\nc"), (1_000_001, rows[0][1]), (17, "long " + "word " * 30_000), (20, "LONG " + "word " * 29_000)]


@pytest.mark.parametrize("words,percent,pieces", [(4, 85, 1000), (5, 80, 12)])
def test_as_brute_force(spark, monkeypatch, words, percent, pieces):
    monkeypatch.setattr(N, "HOT_TERMS", 400)
    monkeypatch.setattr(N, "PIECE_SETS", pieces)
    rows = corpus(words, 260)
    df = spark.createDataFrame([(d, t, d, "x") for d, t in rows], "doc_id long, text string, node long, key string").repartition(5)
    got = sorted(tuple(r) for r in N.groups(df, words, percent).collect())
    assert got == brute(rows, words, percent)


def test_search_alone():
    r = np.random.default_rng(1)
    for _ in range(60):
        base = r.integers(0, 200, 40).astype(np.uint64)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(1, 40)), r.integers(0, 200, r.integers(0, 4)).astype(np.uint64)])) for _ in range(25)]
        want = brute([(i, " ".join(str(x) for x in s)) for i, s in enumerate(sets)], 1, 70)
        assert [w[2] for w in want] == N.linked(sets, 70)


def test_keeps_one_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, None, 7), (4, "", 8), (3, None, 7)], "doc_id long, text string, n long")
    assert sorted(r.doc_id for r in N.one_of_each(df).collect()) == [1, 3, 3, 4]
    assert N.groups(df.limit(0)).count() == 0


def test_rows_without_an_id_link(spark):
    """1 - null - 2 is a chain; the null row gets the least id. Two null rows that link with each other alone have none."""
    w, x, y = ([f"{c}{i}" for i in range(n)] for c, n in (("t", 200), ("x", 12), ("y", 12)))
    rows = [(1, w), (None, w[:188] + x), (2, w[:176] + y + x), (None, ["q"] * 3 + ["r"] * 9), (None, ["q"] * 3 + ["r"] * 9)]
    df = spark.createDataFrame([(d, " ".join(t), "z") for d, t in rows], "doc_id long, text string, alike string").repartition(3)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in N.groups(df, 4, 80).collect()) == [("1", "1"), ("2", "1"), ("None", "1"), ("None", "None"), ("None", "None")]
    assert brute([(1, " ".join(w)), (2, " ".join(rows[2][1]))], 4, 80)[1][2] == 2


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(7)
    for percent in (70, 80, 85):
        bands = N.Bands(percent, 1 << 20)
        for _ in range(150):
            n = int(r.integers(1, 300))
            a = r.integers(0, 1 << 62, n).astype(np.uint64)
            k = int(r.integers(0, n * (100 - percent) // 100 + 1))
            b = np.concatenate([a[k:], r.integers(0, 1 << 62, int(r.integers(0, k + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            hot = np.unique(np.concatenate([a[r.random(len(a)) < r.random()], b[r.random(len(b)) < 0.2]]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                for h in (None, hot):
                    assert len(np.intersect1d(N.signatures(a, bands, h), N.signatures(b, bands, h)))


def test_large_components_are_split_and_shuffles_deleted(spark, monkeypatch):
    """Documents with a passage in common are candidates of each other: only those that may link meet again, and no shuffled data of a step is left after it."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager

    def shuffled():
        found = files().getAllFiles()
        return sum(f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_"))

    monkeypatch.setattr(N, "PIECE_SETS", 20)
    monkeypatch.setattr(N, "ROUND", 1000, raising=False)
    tables, cut = [], N.cut
    monkeypatch.setattr(N, "cut", lambda df, name, **more: tables.append((name, cut(df, name, **more))) or tables[-1][1])
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"o{i}-{j}" for j in range(20))) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 120, 10)] + [(2000 + i, rows[i][1] + " more and more") for i in range(0, 120, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled()
    got = sorted(tuple(r) for r in N.groups(df).collect())
    left = shuffled() - before
    assert got == brute(rows, 5, 80) and len({r[2] for r in got}) == 120
    sizes = [t.groupBy("root").count().toPandas()["count"].max() for name, t in tables if name == "chosen"]
    assert sizes[0] > 100 and sizes[-1] == 3
    assert sum(name == "candidates" for name, _ in tables) == N.ROUNDS and left < 100_000, left
