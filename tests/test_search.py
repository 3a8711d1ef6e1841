import math
import random
import re

import pytest

from lorekeep.functions.embed import CallableProvider, HashingProvider, get_provider
from lorekeep.operators import fts, search
from lorekeep.operators.store import Store

NOTES = [("1", "apples.md", "Apples", "cider apples ripen in autumn", "s1", "orchard", "apples,autumn"), ("2", "bees.md", "Bees", "honey from the heather hive", "s2", "apiary", "honey"), ("3", "mead.md", "Mead", "apples and honey, more apples", "s3", "orchard", "apples,honeydew")]
CODE = [("1", "def press_cider(apples, barrels):\n    pass", "press.py", "orchard", "python", "function"), ("2", "export class HiveMap { findQueen() {} }", "hive.ts", "apiary", "typescript", "class"), ("3", "def fill_jar(): pass", "jar.py", "orchard", "python", "function")]


@pytest.fixture(scope="module")
def notes(spark):
    e = HashingProvider(16)
    vs = e.embed_texts([n[3] for n in NOTES])
    return spark.createDataFrame([(*n, v) for n, v in zip(NOTES, vs)], "id string, source_file string, heading string, text string, session_id string, project string, tags string, vector array<float>")


@pytest.fixture(scope="module")
def code(spark):
    vs = HashingProvider(16).embed_texts([c[1] for c in CODE])
    return spark.createDataFrame([(*c, v) for c, v in zip(CODE, vs)], "id string, text string, source_file string, repo_name string, language string, chunk_type string, vector array<float>")


def ids(df):
    return [r.id for r in df.collect()]


def test_notes_by_text(notes):
    assert ids(search.search_notes(notes, "apples"))[0] == "3" and "vector" not in search.search_notes(notes, "apples").columns
    assert ids(search.search_notes(notes, "apples", project="apiary")) == []
    assert ids(search.search_notes(notes, "honey apples", tags="apples, honey")) == ["3"]  # LIKE: honeydew
    assert ids(search.search_notes(notes, "honey apples", tags="apples, honey", exact_tags=True)) == []
    assert ids(search.search_notes(notes, "", top_k=3)) == [] and ids(search.search_notes(notes, "zebra")) == []


def test_modes(notes):
    with pytest.raises(ValueError, match="Unsupported search mode"):
        search.search_notes(notes, "x", mode="magic")
    with pytest.raises(ValueError, match="requires an embedder"):
        search.search_notes(notes, "x", mode="hybrid")
    e = HashingProvider(16)
    r = search.search_notes(notes, NOTES[1][3], mode="vector", embedder=e, top_k=2).collect()
    assert r[0].id == "2" and r[0].score < 1e-9 and r[0].score_kind == "distance" and r[0].score <= r[1].score
    h = search.search_notes(notes, "honey", mode="hybrid", embedder=e).collect()
    assert {x.id for x in h} == {"1", "2", "3"} and h[0].score_kind == "rrf"


def test_code(code):
    assert ids(search.search_code(code, "press_cider")) == ["1"] and ids(search.search_code(code, "HiveMap")) == ["2"]
    assert ids(search.search_code(code, "findQueen")) == ["2"] and ids(search.search_code(code, "fill_jar")) == ["3"]
    assert ids(search.search_code(code, "def", language="typescript")) == [] and ids(search.search_code(code, "def", repo_name="orchard", chunk_type="function")) == ["3", "1"]
    assert ids(search.find_similar(code, CODE[2][1], HashingProvider(16), top_k=1)) == ["3"]


def test_everything(notes, code):
    r = search.search_everything(notes, code, "apples def", top_k=5).collect()
    assert {x.kind for x in r} == {"note", "code"}


def fused(a, b, k, rrf):
    scores = {}
    for hits in (a, b):
        for r, i in enumerate(hits):
            scores[i] = scores.get(i, 0.0) + 1 / (rrf + r + 1)
    return sorted(scores.items(), key=lambda x: -x[1])[:k]


def test_fusion_with_ties(spark):
    r = random.Random(2)
    for _ in range(6):
        a, b = (r.sample(range(12), r.randint(0, 8)) for _ in range(2))
        df = lambda xs: spark.createDataFrame([(i, n + 1) for n, i in enumerate(xs)], "id int, rank int")
        assert [(x.id, x.score) for x in search.fuse(df(a), df(b), 6).collect()] == fused(a, b, 6, 60)


def plain_bm25(docs, query):
    ws = {i: [w for w in re.split(r"[^\w]|_", t.lower()) if w] for i, t in docs}
    n, avg = len(docs), sum(map(len, ws.values())) / len(docs)
    out = {}
    for w in dict.fromkeys(x for x in re.split(r"[^\w]|_", query.lower()) if x):
        df = sum(w in x for x in ws.values())
        for i, x in ws.items():
            if tf := x.count(w):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
    return out


def test_bm25_both_ways(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["Ab", "cd_ef", "élan", "x-y", "z"]) for _ in range(r.randint(0, 30)))) for i in range(60)]
    df = spark.createDataFrame(docs, "id int, text string")
    want = plain_bm25(docs, "AB élan ab y")
    assert {x.id: round(x.score, 9) for x in fts.bm25(df, "AB élan ab y").collect()} == {i: round(s, 9) for i, s in want.items()}
    qs = spark.createDataFrame([(7, "AB élan ab y"), (8, "nothing")], "query_id int, query string")
    assert {x.id: round(x.score, 9) for x in fts.search(fts.build(df), qs).collect()} == {i: round(s, 9) for i, s in want.items()}


def test_stored_index(spark, tmp_path, notes):
    """The same hits with an index that is read from folders as without one; only the folders of the query's terms are read."""
    s = Store(spark, str(tmp_path / "st"))
    postings, lengths = fts.counts(notes)
    s.commit({"notes_postings": fts.by_bucket(postings), "notes_corpus": lengths.selectExpr("count(*) AS n", "sum(dl) AS total")}, {"notes_postings": ["bucket"]})
    index = fts.stored(s.now(), "notes")
    assert fts.stored(s.now(), "code") is None
    for query, how in (("apples", {}), ("honey apples hive", {"project": "orchard"}), ("zebra", {}), ("", {}), ("HONEY hive", {"tags": "honey"})):
        a, b = ([(r.id, round(r.score, 9)) for r in search.search_notes(notes, query, index=x, **how).collect()] for x in (index, None))
        assert a == b
    qs = spark.createDataFrame([(7, "honey apples"), (8, "nothing")], "query_id int, query string")
    a, b = ({(r.query_id, r.id, round(r.score, 9)) for r in fts.search(x, qs).collect()} for x in (index, fts.build(notes)))
    assert a == b and a
    plan = fts.bm25_indexed(index, "honey")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,honey)" in plan


def test_batch_as_single(spark, notes):
    q = notes.select(notes.id.alias("query_id"), "vector")
    got = {(x.query_id, x.rank): (x.id, round(x.score, 5)) for x in search.vector_search_batch(notes, q, 2).collect()}
    for row in q.collect():
        one = search.vector_search(notes, list(row.vector), 2).collect()
        assert [got[row.query_id, k + 1] for k in range(2)] == [(x.id, round(x.score, 5)) for x in one]


def test_batch_ties_and_near_copies(spark):
    copies = [(i, [1.0, 2.0]) for i in range(1000)]
    large = [(2000 + i, [1e8 + (999 - i) * 1e-3, -1e8]) for i in range(1000)]
    df = spark.createDataFrame(copies + large, "id long, vector array<double>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 2.5]), (1, [1e8, -1e8])], "query_id long, vector array<double>")
    rows = sorted((r.query_id, r["rank"], r.id) for r in search.vector_search_batch(df, q, 5).collect())
    assert [i for _, _, i in rows] == [0, 1, 2, 3, 4, 2999, 2998, 2997, 2996, 2995]


def test_plans(spark, tmp_path, notes):
    notes.write.mode("overwrite").parquet(str(tmp_path / "n"))
    df = spark.read.parquet(str(tmp_path / "n"))
    plan = search.vector_search(df, [0.0] * 16, 3, df.project == "orchard")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(project,orchard)" in plan and "Exchange" not in plan
    assert "vector" not in fts.bm25(df, "apples").inputFiles() and "vector:array" not in search.text_search(df, "apples")._jdf.queryExecution().executedPlan().toString()


def test_providers():
    with pytest.raises(ValueError, match="Unknown embedding provider"):
        get_provider("nothing")
    tries = []

    def fails():
        tries.append(1)
        raise RuntimeError

    p = CallableProvider(fails, 1, "m", fallback=lambda: lambda ts: [[float(len(t))] for t in ts])
    assert p.embed_texts(["a", "bb", "ccc"], batch_size=2) == [[1.0], [2.0], [3.0]] and tries == [1] and p.embed_query("dddd") == [4.0]
    assert get_provider("hashing", dimension=384).dimension == 384
