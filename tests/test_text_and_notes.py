import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.text import content_hash, project_name, strip, terms, truncate
from lorekeep.operators import context, costs, markdown
from lorekeep.plans import catalog


def one(spark, col, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(col.alias("x")).first().x


def test_text(spark):
    t = F.col("t")
    assert one(spark, content_hash(t), t="beans é") == "sha256:" + hashlib.sha256("beans é".encode()).hexdigest()
    assert one(spark, strip(t), t="\n\x1c  a b \t") == "a b" and one(spark, truncate(t, 3), t="abcd") == "abc..." and one(spark, truncate(t, 4), t="abcd") == "abcd"
    assert one(spark, terms(t), t="sowDate_x, Élan!") == ["sowdate", "x", "élan"]
    assert [one(spark, project_name(t), t=x) for x in ("/a/b/", "", "x")] == ["b", "unknown", "x"]


CASES = [
    ("---\nsession_id: k-77\nproject: garden\ntags: [seeds, spring]\n---\n\n## Sowing", ("k-77", "garden", ["seeds", "spring"], "## Sowing")),
    ("No front matter at all.", ("", "", [], "No front matter at all.")),
    ("---\nproject: 'a: b'\nproject: \"c\"\ntags: [#x, , y]\n---\nT", ("", "c", ["x", "y"], "T")),
    ("---\nno end", ("", "", [], "---\nno end")),
]


@pytest.mark.parametrize("text,want", CASES)
def test_front_matter(spark, text, want):
    r = one(spark, markdown.front_matter(F.col("t")), t=text)
    assert (r.session_id, r.project, r.tags, r.body) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("## Peas\nsow in March\n\n## Beans\nsow in May\n", [("Peas", "## Peas\nsow in March"), ("Beans", "## Beans\nsow in May")]),
        ("one line, no heading", [("", "one line, no heading")]),
        ("before\n### In\nx\n# One\n#### Four", [("(preamble)", "before"), ("In", "### In\nx\n# One\n#### Four")]),
        ("  \n", []),
        ("##\nNext\nbody", [("Next", "##\nNext\nbody")]),
    ],
)
def test_heading_chunks(spark, text, want):
    assert [(c.heading, c.text) for c in one(spark, markdown.heading_chunks(F.col("t")), t=text)] == want


def test_note_rows(spark):
    df = spark.createDataFrame([("a.md", "---\nproject: p\ntags: [x, y]\n---\n\n## Rain\nnone so far\n", "sha256:h")], "source_file string, content string, content_hash string")
    r = markdown.chunk_notes(df).collect()
    assert len(r) == 1 and (r[0].id, r[0].heading, r[0].tags, r[0].project, r[0].chunk_index) == ("sha256:h_0", "Rain", "x,y", "p", 0)


def test_durations(spark):
    at = lambda h, m: F.lit(datetime(2025, 11, 20, h, m))
    x = spark.range(1).select(markdown.duration(at(9, 10), at(11, 15)).alias("a"), markdown.duration(at(9, 10), at(9, 33)).alias("b"), markdown.duration(at(10, 0), F.lit(None).cast("timestamp")).alias("c"), markdown.yaml(F.lit('a: "b"')).alias("d"), markdown.yaml(F.lit("plain")).alias("e")).first()
    assert tuple(x) == ("2h 5m", "23m", "unknown", '"a: \\"b\\""', "plain")


def test_code_context(spark):
    df = spark.createDataFrame([("f.py", "a\nb\r\nc\x0cd\ne\n")], "source_file string, content string")
    r = context.code_context(df, 2, 3, 1).orderBy("line_no").collect()
    assert [x.shown for x in r] == ["     1 | a", "→    2 | b", "→    3 | c", "     4 | d"]


def test_code_context_of_all_documents(spark, tmp_path):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    docs = list(enumerate((f"a{e}{e}b{e}c d{e}e{end}" for e in ends for end in ("", e)), 190))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.source_file, r.line_no, r.marked, r.shown) for r in catalog.code_context(spark, str(tmp_path)).collect())
    want = [(f"f{n}", k, 2 <= k <= 3, f"{'→ ' if 2 <= k <= 3 else '  '}{k:4d} | {line}") for n, t in docs for k, line in enumerate(t.splitlines()[:4], 1)]
    assert got == sorted(want)


def test_embed_hashing_takes_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "word " * 20_000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: len(r.vector) for r in catalog.embed_hashing(spark, str(tmp_path)).collect()}
    assert got == {1: 64, 2: 64}


def test_costs(spark, tmp_path):
    p = str(tmp_path / "ledger")
    now = datetime(2025, 11, 20, 12)
    costs.record(spark, p, "m", 420, 1, 0.02, now)
    costs.record(spark, p, "m", 77, 2, 0.003, now)
    (tmp_path / "ledger" / "bad.json").write_text('not json\n\n{"model": "m", "tokens": 9}\n{"ts": "2020-01-01T00:00:00", "tokens": 7}\n')
    r = costs.summary(costs.read(spark, p), "month", F.lit(now)).first()
    assert (r.total_tokens, r.total_requests, round(r.total_cost, 6), r.entries) == (497, 3, 0.023, 2)
    with pytest.raises(ValueError):
        costs.summary(costs.read(spark, p), "year")
    empty = costs.summary(costs.read(spark, p).limit(0)).first()
    assert tuple(empty) == (0, 0, 0.0, 0)
