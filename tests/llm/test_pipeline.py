import hashlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lorekeep.llm import queries
from lorekeep.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Each stage keeps columns and only drops or changes what it is for; the last agrees with the library on all texts that are left."""
    docs = read(spark, SF, "documents")
    kinds, before = docs.dtypes, {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.dtypes == kinds, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name != "pii":
            assert all(before[i] == t for i, t in after.items())
        before = after
    assert not any("@mail" in t for t in before.values())
    t = Tokenizer.from_file(queries.tokenizer_path())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == len(before)
    for r in last:
        assert r.ids_sha256 == hashlib.sha256(np.array(t.encode(before[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


CLASHING = ("lk_bad", "lk_gone", "lk_own", "lk_doc", "lk_text", "lk_a", "lk_b", "lk_marks", "marks", "key", "node", "alike", "n", "row", "kind", "score", "predicted", "held_out", "item_id", "id", "root", "a", "b", "start", "stop")


def test_stages_with_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, ties, one long text and extra columns whose names the operators use themselves."""
    good = "the committee met in the old town hall and agreed on a plan for the new school that opens next year"
    rows = [(1, good), (1, good), (2, None), (None, good + " again"), (3, ""), (4, "write to me@mail.org now"), (4, "write to you@mail.org now"), (5, "long text " * 20_000), (6, good)]
    extra = [(*r, *(f"{c}{i}" for c in CLASHING)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(extra, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    kinds = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == kinds, name
        before, after = docs.collect(), out.collect()
        own = {r.node: r for r in before}  # a column that each row has another value in
        assert all(r.node in own and r.doc_id == own[r.node].doc_id and [r[c] for c in CLASHING] == [own[r.node][c] for c in CLASHING] for r in after), name
        if name == "near_copies":
            assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.doc_id != 6)
        if name == "pii":
            assert sorted(r.text for r in after if r.doc_id == 4) == ["write to [EMAIL] now"] * 2 and [r.text for r in after if r.doc_id == 2] == [None]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and [r.n_tokens for r in last if r.doc_id == 2] == [0]


def test_stages_without_rows(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_as_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name]).df()[sorted(df.columns)]
    assert sorted(map(tuple, df.toPandas()[sorted(df.columns)].values.tolist())) == sorted(map(tuple, want.values.tolist()))
