"""Queries over the driver's tables, which stand for notes, code, messages and the ledger, and the same in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import schemas
from lorekeep.functions.embed import EmbeddingProvider, HashingProvider, cost, embed, requests
from lorekeep.functions.text import content_hash, preview, truncate
from lorekeep.operators import context, costs, fts, incremental, markdown, search, sessions, store, transcripts
from lorekeep.operators.codechunk import chunk_sources
from lorekeep.streaming import ledger as streams

TEXT_QUERY, MULTI_QUERY = "the license under and éouvi", "licensed version released und le"
TERM = r"[^\p{L}\p{N}]+"
L2 = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return _t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


# --- vectors ---


def _nearest(spark, d, vec_id, condition=None):
    hits = search.vector_search(_t(spark, d, "embeddings"), _vector(spark, d, vec_id), 10, condition, key="vec_id", vector="embedding")
    return hits.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT a.vec_id, a.label, round({L2}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {L2}, a.vec_id LIMIT 10")
def vector_topk(spark, d):
    return _nearest(spark, d, 0)


@query(f"SELECT a.vec_id, a.label, round({L2}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE a.label = 3 ORDER BY {L2}, a.vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return _nearest(spark, d, 3, F.col("label") == 3)


@query(f"""SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, vec_id) AS INTEGER) AS rank FROM (
        SELECT q.vec_id AS query_id, a.vec_id, {L2} AS s FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 25 = 0) q)) WHERE rank <= 5""")
def vector_topk_batch(spark, d):
    e = _t(spark, d, "embeddings")
    hits = search.vector_search_batch(e, e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, key="vec_id", vector="embedding")
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- search over notes and code ---


class _Given(EmbeddingProvider):
    """The vector of a stored row, for whatever text."""

    dimension, model_name = property(lambda self: len(self.vector)), "given"

    def __init__(self, spark, d, vec_id):
        self.vector = list(_vector(spark, d, vec_id))

    def embed_texts(self, texts, batch_size=64):
        return [self.vector for _ in texts]


def _notes(spark, d, vectors: bool = False):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_file"), "text", F.col("lang").alias("project"), F.col("source").alias("tags"), F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string")).alias("session_id"))
    return docs.join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id", "left") if vectors else docs


def _code(spark, d, vectors: bool = False):
    kind = F.when(F.col("id") % 2 == 0, "class").otherwise("function")
    return _notes(spark, d, vectors).withColumnsRenamed({"project": "language", "tags": "repo_name"}).withColumn("chunk_type", kind)


_WORDS = rf"""words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{TERM}'), lambda w: w <> '')) AS term FROM documents),
    tf AS (SELECT term, doc_id, count(*) AS tf FROM words GROUP BY ALL),
    dl AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '{TERM}'), lambda w: w <> '')) AS dl FROM documents),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _text_leg(q: str, condition: str = "true", k: int = 10) -> str:
    words = ", ".join(f"'{w}'" for w in fts.query_terms(q))
    return f"SELECT doc_id, lang, score FROM (SELECT doc_id, sum({_BM25}) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), corpus WHERE term IN ({words}) GROUP BY doc_id) JOIN documents USING (doc_id) WHERE {condition} ORDER BY score DESC, doc_id LIMIT {k}"


def _bm25_sql(q: str, condition: str = "true", k: int = 10) -> str:
    return f"WITH {_WORDS} SELECT doc_id, lang, round(score, 6) AS score FROM ({_text_leg(q, condition, k)})"


def _store(spark, d):
    """A store of this application for the tables of d."""
    return store.Store(spark, f"{store.scratch(spark)}/{hashlib.sha256(d.encode()).hexdigest()[:16]}")


@query(f"WITH {_WORDS} SELECT n, CAST((SELECT sum(dl) FROM dl) AS BIGINT) AS total, (SELECT count(*) FROM tf) AS postings FROM corpus")
def text_index_build(spark, d):
    """Writes the index of all documents' terms, which the text queries after it read."""
    s = _store(spark, d)
    postings, lengths = fts.counts(_t(spark, d, "documents"), "doc_id")
    total = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))
    s.commit({"documents_postings": fts.by_bucket(postings), "documents_corpus": total}, {"documents_postings": ["bucket"]})
    now = s.now()
    return now.rows("documents_corpus").crossJoin(now.rows("documents_postings").agg(F.count("*").alias("postings")))  # one row each


def _text_index(spark, d) -> fts.Index:
    if fts.stored(_store(spark, d).now(), "documents") is None:
        text_index_build(spark, d)
    return fts.stored(_store(spark, d).now(), "documents")


def _named(hits):
    return hits.select(F.col("id").alias("doc_id"), F.col("project").alias("lang"), F.round("score", 6).alias("score"))


@query(_bm25_sql(TEXT_QUERY))
def text_search_bm25(spark, d):
    return _named(search.search_notes(_notes(spark, d), TEXT_QUERY, index=_text_index(spark, d)))


@query(_bm25_sql(MULTI_QUERY))
def text_search_scan(spark, d):
    """Without an index: all texts are read."""
    return _named(search.search_notes(_notes(spark, d), MULTI_QUERY))


@query(_bm25_sql(MULTI_QUERY, "lang = 'de'"))
def text_search_filtered(spark, d):
    return _named(search.search_notes(_notes(spark, d), MULTI_QUERY, project="de", index=_text_index(spark, d)))


@query(_bm25_sql(MULTI_QUERY, "source LIKE '%rc1%' AND doc_id % 10 = 3"))
def text_search_tags_session(spark, d):
    return _named(search.search_notes(_notes(spark, d), MULTI_QUERY, tags="rc1", session_id="s3", index=_text_index(spark, d)))


@query(_bm25_sql(TEXT_QUERY, "lang = 'en' AND doc_id % 2 = 1", 5))
def code_search_text(spark, d):
    hits = search.search_code(_code(spark, d), TEXT_QUERY, top_k=5, language="en", chunk_type="function", index=_text_index(spark, d))
    return _named(hits.withColumnRenamed("language", "project"))


@query(f"SELECT a.vec_id AS doc_id, round({L2}, 6) AS score FROM embeddings a JOIN documents ON doc_id = a.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 9) q WHERE lang = 'fr' ORDER BY {L2}, a.vec_id LIMIT 10")
def notes_search_vector(spark, d):
    hits = search.search_notes(_notes(spark, d, True), "", mode="vector", project="fr", embedder=_Given(spark, d, 9))
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT a.vec_id, round({L2}, 6) AS score FROM embeddings a JOIN documents ON doc_id = a.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE lang = 'de' ORDER BY {L2}, a.vec_id LIMIT 5")
def find_similar(spark, d):
    hits = search.find_similar(_code(spark, d, True), "", _Given(spark, d, 7), top_k=5, language="de")
    return hits.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""WITH {_WORDS}, t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS tr FROM ({_text_leg(TEXT_QUERY)})),
    v AS (SELECT a.vec_id AS doc_id, row_number() OVER (ORDER BY {L2}, a.vec_id) AS vr FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE a.vec_id IN (SELECT doc_id FROM documents) ORDER BY vr LIMIT 10)
    SELECT doc_id, round(coalesce(1.0 / (60 + tr), 0) + coalesce(1.0 / (60 + vr), 0), 9) AS score FROM t FULL JOIN v USING (doc_id) ORDER BY coalesce(1.0 / (60 + tr), 0) + coalesce(1.0 / (60 + vr), 0) DESC, tr NULLS LAST, vr NULLS LAST LIMIT 10""")
def hybrid_rrf(spark, d):
    hits = search.search_notes(_notes(spark, d, True), TEXT_QUERY, mode="hybrid", embedder=_Given(spark, d, 5), index=_text_index(spark, d))
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query(f"""WITH {_WORDS}, a AS (SELECT 'note' AS kind, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_text_leg(TEXT_QUERY, k=6)})),
    b AS (SELECT 'code' AS kind, doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_text_leg(TEXT_QUERY, k=6)}))
    SELECT kind, doc_id, round(1.0 / (60 + r), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY r, kind DESC LIMIT 6""")
def search_everything(spark, d):
    hits = search.search_everything(_notes(spark, d), _code(spark, d), TEXT_QUERY, top_k=6, index=_text_index(spark, d))
    return hits.select("kind", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query(f"""WITH {_WORDS}, qs AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '{TERM}'), lambda w: w <> ''))) AS term FROM benchmark),
    s AS (SELECT item_id AS query_id, doc_id, sum({_BM25}) AS score FROM qs JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), corpus GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) WHERE r <= 3""")
def text_search_batch(spark, d):
    qs = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = fts.search(_text_index(spark, d), qs, "doc_id")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return hits.withColumn("r", F.row_number().over(order)).where("r <= 3").select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_WORDS} SELECT term, doc_id AS id, CAST(tf AS BIGINT) AS tf FROM tf")
def postings_build(spark, d):
    return fts.build(_t(spark, d, "documents"), "doc_id").postings.select("term", "id", "tf")


@query(f"WITH {_WORDS} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS terms, (SELECT CAST(max(df) AS BIGINT) FROM df) AS max_df FROM corpus")
def corpus_stats(spark, d):
    ix = fts.build(_t(spark, d, "documents"), "doc_id")
    freq = ix.postings.groupBy("term").agg(F.count("*").alias("df")).agg(F.count("*").alias("terms"), F.max("df").alias("max_df"))
    return ix.corpus.crossJoin(freq).select("n", F.round("avgdl", 6).alias("avgdl"), "terms", "max_df")  # one row each


# --- identity, previews ---


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hashes(spark, d):
    return _t(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


@query("SELECT 'sha256:' || sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_chunks(spark, d):
    return _t(spark, d, "documents").groupBy(content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS cut, replace(left(text, 300), chr(10), ' ') || CASE WHEN length(text) > 300 THEN '...' ELSE '' END AS preview FROM documents")
def previews(spark, d):
    return _t(spark, d, "documents").select("doc_id", truncate(F.col("text")).alias("cut"), preview(F.col("text"), 300).alias("preview"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE source LIKE '%rc1%' AND source LIKE '%1%' AND lang = 'en'")
def tag_filter(spark, d):
    from lorekeep.operators.filters import notes_filter

    df = _t(spark, d, "documents").withColumnsRenamed({"source": "tags", "lang": "project"})
    return df.where(notes_filter(project="en", tags="rc1, 1,")).select("doc_id", F.length("text").cast("long").alias("n"))


# --- merges ---


def _old_new(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("bal"))
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit("-new")))


_OLD_NEW = "o AS (SELECT c_custkey, c_name, round(c_acctbal, 2) AS bal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, c_name || '-new' AS c_name, round(c_acctbal, 2) AS bal FROM customer WHERE c_custkey % 2 = 0)"


@query(f"WITH {_OLD_NEW} SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_merge(spark, d):
    return store.merge(*_old_new(spark, d), ["c_custkey"])


@query(f"WITH {_OLD_NEW} SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def insert_absent(spark, d):
    return store.insert_absent(*_old_new(spark, d), ["c_custkey"])


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7')")
def delete_by_source(spark, d):
    gone = spark.range(1).select(F.explode(F.array(F.lit("src0"), F.lit("src7"))).alias("source"))
    return store.delete(_t(spark, d, "documents").select("doc_id", "source"), gone, ["source"])


@query("SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source")
def last_upsert_wins(spark, d):
    return store.last_wins(_t(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


def _scan(spark, d):
    return _t(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_file"), content_hash(F.col("text")).alias("content_hash"), "doc_id")


def _index(spark, d):
    rows = _scan(spark, d).where("doc_id % 11 <> 0").select("source_file", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return rows.unionByName(spark.range(3).select(F.concat(F.lit("gone"), F.col("id").cast("string")).alias("source_file"), F.lit("x").alias("content_hash")))


@query("SELECT 'f' || doc_id AS source_file, 'sha256:' || sha256(text) AS content_hash FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0")
def file_diff_changed(spark, d):
    return incremental.changed(_scan(spark, d).drop("doc_id"), _index(spark, d))


@query("SELECT * FROM (VALUES ('gone0', 'x'), ('gone1', 'x'), ('gone2', 'x')) t(source_file, content_hash)")
def file_diff_stale(spark, d):
    return incremental.stale(_scan(spark, d), _index(spark, d))


# --- messages and notes ---

_LABEL = "CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END"
_SECTION = f"'### ' || {_LABEL} || CASE WHEN trim(text, ' \t\n\r') = '' THEN '' ELSE chr(10) || trim(text, ' \t\n\r') END"
_MSGS = "(SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"


def _messages(spark, d):
    return _t(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))


def _talks(spark, d):
    return markdown.conversations(_messages(spark, d), "conv_id", "turn", markdown.message(F.col("role"), F.col("text")))


_TALK = f"(SELECT conv_id, string_agg({_SECTION} || chr(10), chr(10) ORDER BY turn) AS talk FROM {_MSGS} GROUP BY conv_id)"
_DOC = """'---' || chr(10) || 'session_id: s' || conv_id || chr(10) || 'project: p' || (conv_id % 3) || chr(10) || 'cwd: "/w:x/p' || (conv_id % 3) || '"' || chr(10) || 'started: 2024-01-01T10:00:00+00:00' || chr(10)
    || 'ended: 2024-01-01T11:30:00+00:00' || chr(10) || 'tags: [claude-session, p' || (conv_id % 3) || ']' || chr(10) || '---' || chr(10) || chr(10) || '# Session: Session s' || conv_id || chr(10)
    || '**Date:** 2024-01-01 | **Duration:** 1h 30m | **Project:** p' || (conv_id % 3) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Conversation' || chr(10) || chr(10) || talk"""


def _documents(spark, d):
    p = F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string"))
    rows = _talks(spark, d).select("conv_id", "conversation", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("/w:x/"), p).alias("cwd"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("started_at"), F.lit("2024-01-01 11:30:00").cast("timestamp").alias("ended_at"), F.lit("").alias("summary"))
    return markdown.document(rows)


@query(f"SELECT conv_id, {_DOC} AS body FROM {_TALK}")
def transcript_markdown(spark, d):
    return _documents(spark, d).select("conv_id", "body")


@query(f"SELECT conv_id, chr(10) || '---' || chr(10) || chr(10) || '## Resumed (2024-01-02T00:00:00+00:00)' || chr(10) || chr(10) || talk AS section FROM {_TALK}")
def resumed_section(spark, d):
    return _talks(spark, d).select("conv_id", markdown.resumed(F.col("conversation"), F.lit("2024-01-02 00:00:00").cast("timestamp")).alias("section"))


@query(f"""WITH docs AS (SELECT conv_id, {_DOC} AS body FROM {_TALK}), b AS (SELECT conv_id, regexp_replace(body, '^---\n(?s:.*?)\n---\n+', '') AS body FROM docs),
    p AS (SELECT conv_id, string_split(regexp_replace(body, '(^|\n)(#{{2,3}}[ \t]+[^\n]+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM b),
    c AS (SELECT conv_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
    k AS (SELECT conv_id, i, CASE WHEN i = 1 THEN '(preamble)' ELSE trim(regexp_extract(part, '^#{{2,3}}[ \t]+([^\n]+)', 1), ' \t\r') END AS heading, trim(part, ' \t\n\r') AS text FROM c)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, heading, text FROM k WHERE text <> ''""")
def heading_chunks(spark, d):
    rows = _documents(spark, d).select(F.col("conv_id").cast("string").alias("source_file"), F.lit("h").alias("content_hash"), F.col("body").alias("content"))
    return markdown.chunk_notes(rows).select(F.col("source_file").cast("long").alias("conv_id"), "chunk_index", "heading", "text")


@query(f"SELECT conv_id, 's' || conv_id AS session_id, 'p' || (conv_id % 3) AS project, 'claude-session,p' || (conv_id % 3) AS tags FROM {_TALK}")
def frontmatter_fields(spark, d):
    return _documents(spark, d).select("conv_id", markdown.front_matter(F.col("body")).alias("f")).select("conv_id", "f.session_id", "f.project", F.array_join("f.tags", ",").alias("tags"))


@query(f"SELECT conv_id, '2024-01-01_s' || left(conv_id::VARCHAR, 7) || '_p' || (conv_id % 3) || '.md' AS rel_path FROM {_TALK}")
def note_paths(spark, d):
    docs = _documents(spark, d)
    return docs.select("conv_id", markdown.note_path(docs).alias("rel_path"))


_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH l AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(?:{_LINE_END})\z', ''), '{_LINE_END}') AS ls FROM documents),
    x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l)
    SELECT 'f' || doc_id AS source_file, CAST(i AS INTEGER) AS line_no, i BETWEEN 2 AND 3 AS marked, CASE WHEN i BETWEEN 2 AND 3 THEN '→ ' ELSE '  ' END || lpad(i::VARCHAR, 4, ' ') || ' | ' || line AS shown FROM x WHERE i >= 1 AND i <= 4""")
def code_context(spark, d):
    docs = _t(spark, d, "documents")
    return context.code_context(docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_file"), F.col("text").alias("content")), 2, 3, 1)


# --- transcripts: the conversations as the JSON lines that a chat client writes ---

_ID = "00000000-0000-0000-0000-"
_SESSION = f"'{_ID}' || lpad(conv_id::VARCHAR, 12, '0')"


def _lines(spark, d):
    """A line of a message or, of a system's, of a summary; every second message uses a tool and has its result in the next line; then come a broken and a blank line."""
    c, odd = _t(spark, d, "conversations"), F.col("turn") % 2 == 1
    when = F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z"))
    own = lambda k: F.when(F.col("turn") % 8 == k, F.concat(F.lit("run "), F.col("turn").cast("string")))
    tool = F.struct(own(1).alias("command"), own(3).alias("file_path"), own(5).alias("query"), F.when(F.col("turn") % 8 == 7, F.col("turn")).alias("depth"))
    blocks = F.array(F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("name"), F.lit(None).cast(tool_type := "struct<command:string,file_path:string,query:string,depth:bigint>").alias("input")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name"), tool.cast(tool_type).alias("input")))
    cwd = F.when(F.col("turn") >= 2, F.concat(F.lit("/w/p"), (F.col("conv_id") % 3).cast("string")))
    plain = F.to_json(F.struct(F.col("role").alias("type"), when.alias("timestamp"), cwd.alias("cwd"), F.struct("role", F.col("text").alias("content")).alias("message")))
    using = F.to_json(F.struct(F.col("role").alias("type"), when.alias("timestamp"), cwd.alias("cwd"), F.struct("role", blocks.alias("content")).alias("message")))
    first = F.when(F.col("role") == "system", F.to_json(F.struct(F.lit("summary").alias("type"), F.col("text").alias("summary")))).when(odd, using).otherwise(plain)
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("out "), F.col("turn").cast("string")).alias("content")))
    each = F.array(first, F.when(odd & (F.col("role") != "system"), result), F.lit("{broken"), F.lit("  "))
    rows = c.select(F.concat(F.lit(_ID), F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("session_id"), "turn", F.posexplode(each).alias("k", "line"))
    return rows.where("line is not null").select("session_id", (F.col("turn") * 4 + F.col("k")).cast("int").alias("pos"), "line")


_TS = "strftime(TIMESTAMP '2024-01-01 10:00:00' + INTERVAL (turn) DAY, '%Y-%m-%d %H:%M:%S')"
_TOOL = "CASE turn % 8 WHEN 7 THEN '{\"depth\": ' || turn || '}' ELSE 'run ' || turn END"


@query(f"""SELECT {_SESSION} AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n, role, text, {_TS} AS ts,
    CASE WHEN turn % 2 = 1 THEN 'Bash' END AS tool_name, CASE WHEN turn % 2 = 1 THEN {_TOOL} END AS input_summary, CASE WHEN turn % 2 = 1 THEN 'out ' || turn END AS output_summary FROM {_MSGS}""")
def transcript_messages(spark, d):
    msgs = transcripts.with_tools(transcripts.messages(transcripts.parse(_lines(spark, d))))
    use = F.get("tool_uses", F.lit(0))
    return msgs.select("session_id", "n", "role", "text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *(use[k].alias(k) for k in ("tool_name", "input_summary", "output_summary")))


@query(f"SELECT {_SESSION} AS session_id, max_by(text, turn) AS summary FROM conversations WHERE role = 'system' GROUP BY conv_id")
def transcript_summaries(spark, d):
    return transcripts.summaries(transcripts.parse(_lines(spark, d)))


@query(f"""SELECT {_SESSION} AS session_id, CAST(count(*) + count(CASE WHEN turn % 2 = 1 AND role <> 'system' THEN 1 END) + 1 AS BIGINT) AS hashes FROM conversations GROUP BY conv_id""")
def transcript_line_hashes(spark, d):
    return transcripts.line_hashes(transcripts.parse(_lines(spark, d))).groupBy("session_id").agg(F.count("*").alias("hashes"))


@query(f"SELECT DISTINCT {_SESSION} AS session_id, '/w/p' || (conv_id % 3) AS cwd FROM {_MSGS} WHERE turn >= 2")
def transcript_discovery(spark, d):
    return sessions.discover(_lines(spark, d))


@query(f"SELECT {_SESSION} AS session_id, min({_TS}) AS started_at, max({_TS}) AS ended_at, count(*) AS n_messages FROM {_MSGS} GROUP BY conv_id")
def transcript_spans(spark, d):
    spans = transcripts.session_spans(transcripts.messages(transcripts.parse(_lines(spark, d))))
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spans.select("session_id", when("started_at"), when("ended_at"), "n_messages")


@query(f"SELECT {_SESSION} AS session_id, count(*) AS n_messages FROM {_MSGS} GROUP BY conv_id HAVING count(*) >= 5")
def min_messages_filter(spark, d):
    spans = transcripts.session_spans(transcripts.messages(transcripts.parse(_lines(spark, d))))
    return sessions.long_enough(spans, 5).select("session_id", "n_messages")


_CONVS = f"(SELECT conv_id, {_SESSION} AS session_id, count(*) AS n FROM {_MSGS} GROUP BY conv_id HAVING max(turn) >= 2)"


@query(f"""SELECT session_id, CASE WHEN conv_id % 5 = 0 THEN 'completed' WHEN n < 4 THEN 'filtered' ELSE 'processed' END AS outcome, n AS n_messages,
    CASE WHEN conv_id % 5 = 0 OR n >= 4 THEN 'completed' ELSE 'active' END AS status FROM {_CONVS}""")
def backfill(spark, d):
    """Outcomes of all discovered sessions, and the registry after it; some were completed before."""
    lines = _lines(spark, d)
    old = sessions.discover(lines).where("cast(right(session_id, 12) as long) % 5 = 0")
    registry = old.select("session_id", "cwd", F.lit("2024").alias("started_at"), F.lit("h").alias("last_transcript_hash"), F.lit("p").alias("markdown_path"), F.lit("completed").alias("status"))
    outcomes, after = sessions.backfill(lines, registry, min_messages=4)
    return outcomes.join(after.select("session_id", "status"), "session_id").select("session_id", "outcome", F.col("n_messages").cast("long").alias("n_messages"), "status")


@query("SELECT user_id::VARCHAR AS session_id FROM events GROUP BY user_id HAVING user_id % 5 <> 0 OR user_id % 2 = 1")
def not_duplicate_sessions(spark, d):
    done = _registry(spark, d).withColumn("last_transcript_hash", F.when(F.col("session_id").cast("long") % 5 == 0, F.concat(F.lit("h"), "session_id")).otherwise(""))
    new = done.select("session_id", F.when(F.col("session_id").cast("long") % 2 == 1, "other").otherwise(F.concat(F.lit("h"), "session_id")).alias("transcript_hash"))
    return sessions.not_duplicates(new, done).select("session_id")


@query("SELECT user_id::VARCHAR AS session_id FROM events GROUP BY user_id HAVING user_id % 4 <> 1")
def not_completed_sessions(spark, d):
    old = _registry(spark, d)
    done = old.withColumn("status", F.when(F.col("session_id").cast("long") % 4 == 1, "completed").otherwise("active"))
    return sessions.not_completed(old.select("session_id"), done)


# --- the store and what is indexed in it ---


@query("""SELECT 'c' || c_custkey AS id, c_name || CASE WHEN c_custkey % 2 = 0 THEN '-new' ELSE '' END AS name FROM customer WHERE c_custkey % 7 <> 3""")
def store_upsert_delete(spark, d):
    s = _store(spark, d)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
    rows = _t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), "c_custkey")
    s.commit({"customers": rows.where("c_custkey % 3 <> 0").select("id", "name")})
    s.upsert("customers", rows.where("c_custkey % 2 = 0").withColumn("name", F.concat("name", F.lit("-new"))), schema)
    s.upsert("customers", rows.where("c_custkey % 2 = 1 and c_custkey % 3 = 0"), schema)
    gone = rows.where("c_custkey % 7 = 3").select("id")
    s.transact(lambda _: store.Changes(gone={"customers": ("id", gone)}))
    return s.table("customers", schema)


def _vault(spark, d, again: bool = False):
    rows = _documents(spark, d).select(F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit(".md")).alias("source_file"), "conv_id", F.col("body").alias("content"))
    if again:
        new = F.concat(F.lit("## New\nbody "), F.col("conv_id").cast("string"))
        rows = rows.where("conv_id % 7 <> 3").withColumn("content", F.when(F.col("conv_id") % 2 == 0, new).otherwise(F.col("content")))
    return rows.select("source_file", "content", content_hash(F.col("content")).alias("content_hash"))


@query(f"""WITH docs AS (SELECT conv_id, {_DOC} AS body FROM {_TALK} WHERE conv_id % 7 <> 3 AND conv_id % 2 = 1), b AS (SELECT conv_id, regexp_replace(body, '^---\n(?s:.*?)\n---\n+', '') AS body FROM docs),
    p AS (SELECT conv_id, string_split(regexp_replace(body, '(^|\n)(#{{2,3}}[ \t]+[^\n]+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM b),
    c AS (SELECT conv_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
    k AS (SELECT conv_id, i, CASE WHEN i = 1 THEN '(preamble)' ELSE trim(regexp_extract(part, '^#{{2,3}}[ \t]+([^\n]+)', 1), ' \t\r') END AS heading, trim(part, ' \t\n\r') AS text FROM c)
    SELECT 'n' || conv_id || '.md' AS source_file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, heading, text FROM k WHERE text <> ''
    UNION ALL SELECT DISTINCT 'n' || conv_id || '.md', 0, 'New', '## New' || chr(10) || 'body ' || conv_id FROM {_TALK} WHERE conv_id % 7 <> 3 AND conv_id % 2 = 0""")
def notes_index(spark, d):
    """The notes table after a vault was indexed and, some notes changed or gone, indexed again."""
    s = _store(spark, d)
    s.commit({f"notes{k}": None for k in ("", "_files", "_postings", "_corpus")})
    incremental.index_notes(s, _vault(spark, d))
    incremental.index_notes(s, _vault(spark, d, again=True))
    return s.table("notes", schemas.NOTES).select("source_file", "chunk_index", "heading", "text")


# --- ledger and sessions ---


def _ledger(spark, d):
    e = _t(spark, d, "events")
    return e.select("ts", F.col("event_type").alias("model"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("tokens"), F.lit(1).cast("long").alias("requests"), F.col("value").alias("cost"), "user_id")


_LEDGER = "(SELECT ts, event_type AS model, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens, 1 AS requests, value AS cost, user_id FROM events)"


def _cost_sql(days: int) -> str:
    return f"SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens, CAST(coalesce(sum(requests), 0) AS BIGINT) AS total_requests, round(coalesce(sum(cost), 0), 4) AS total_cost, count(*) AS entries FROM {_LEDGER} WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {days} DAY"


def _costs(spark, d, period):
    out = costs.summary(_ledger(spark, d), period, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return out.select("total_tokens", "total_requests", F.round("total_cost", 4).alias("total_cost"), "entries")


@query(_cost_sql(1))
def cost_summary_day(spark, d):
    return _costs(spark, d, "day")


@query(_cost_sql(7))
def cost_summary_week(spark, d):
    return _costs(spark, d, "week")


@query(_cost_sql(30))
def cost_summary_month(spark, d):
    return _costs(spark, d, "month")


@query(f"SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(requests) AS BIGINT) AS requests, round(sum(cost), 4) AS cost, count(*) AS entries FROM {_LEDGER} GROUP BY model")
def cost_by_model(spark, d):
    return costs.by_model(_ledger(spark, d)).withColumn("cost", F.round("cost", 4))


@query("SELECT doc_id, round(ceil(length(text) / 4.0) / 1000 * CASE WHEN doc_id % 2 = 0 THEN 0.00002 ELSE 0 END, 9) AS cost, CAST(ceil(n_chars / 100.0) AS BIGINT) AS requests FROM documents")
def embedding_cost(spark, d):
    model = F.when(F.col("doc_id") % 2 == 0, "text-embedding-3-small").otherwise("other")
    return _t(spark, d, "documents").select("doc_id", F.round(cost(model, F.ceil(F.length("text") / 4)), 9).alias("cost"), requests(F.col("n_chars")).alias("requests"))


@query(f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, model, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS entries FROM {_LEDGER} GROUP BY ALL")
def cost_windows(spark, d):
    return streams.windowed_cost(_ledger(spark, d), "1 day").select("start", "model", "tokens", "entries")


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {_LEDGER} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS entries FROM s GROUP BY user_id, k""")
def activity_sessions(spark, d):
    return streams.activity(_ledger(spark, d), "user_id", "6 hours")


def _registry(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("started_at"))
    sid = F.col("user_id").cast("string")
    return e.select(sid.alias("session_id"), F.concat(F.lit("/Home/Proj"), (F.col("user_id") % 4).cast("string")).alias("cwd"), "started_at", F.lit("").alias("last_transcript_hash"), F.lit("").alias("markdown_path"), F.lit("active").alias("status"))


@query("SELECT user_id::VARCHAR AS session_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS started_at FROM events WHERE user_id % 4 = 1 GROUP BY user_id ORDER BY started_at DESC, session_id LIMIT 10")
def recent_sessions(spark, d):
    return sessions.recent(_registry(spark, d), 10, "proj1").select("session_id", "started_at")


@query("""SELECT user_id::VARCHAR AS session_id, CASE WHEN user_id % 5 = 0 THEN 'h' || user_id ELSE '' END AS last_transcript_hash, CASE WHEN user_id % 5 = 0 THEN 'completed' ELSE 'active' END AS status FROM events GROUP BY user_id
    UNION ALL SELECT 'new', '', 'active'""")
def session_registry_merge(spark, d):
    old = _registry(spark, d)
    new = spark.range(1).select(F.lit("new").alias("session_id"), F.lit("/x").alias("cwd"), F.lit("").alias("started_at")).unionByName(old.select("session_id", F.lit("/other").alias("cwd"), "started_at"))
    ended = old.where("cast(session_id as long) % 5 = 0").select("session_id", F.concat(F.lit("h"), "session_id").alias("transcript_hash"), F.lit("p").alias("path"))
    done = sessions.end(sessions.register(old, new), ended.unionByName(spark.range(1).select(F.lit("nobody").alias("session_id"), F.lit("h").alias("transcript_hash"), F.lit("p").alias("path"))))
    return done.select("session_id", "last_transcript_hash", "status")


# --- what SQL can't express ---


@query()
def html_chunks(spark, d):
    pages = _t(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"), F.lit("pages").alias("repo_name"), F.col("html").alias("content"), content_hash(F.col("html")).alias("content_hash"))
    return chunk_sources(pages)


#: White space as Python has it, for both engines.
_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _covered(files):
    """Of each file the number of its chunks' characters that are no white space, and a hash of them in order."""
    made = chunk_sources(files).groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "").alias("t"))
    bare = F.regexp_replace("t", _BLANK, "")
    return made.select("source_file", F.length(bare).cast("long").alias("n"), F.sha2(bare, 256).alias("sha"))


@query(f"SELECT page_id || '.html' AS source_file, CAST(length(t) AS BIGINT) AS n, sha256(t) AS sha FROM (SELECT page_id, regexp_replace(html, '{_BLANK}', '', 'g') AS t FROM pages) WHERE t <> ''")
def html_chunk_cover(spark, d):
    pages = _t(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"), F.lit("pages").alias("repo_name"), F.col("html").alias("content"), content_hash(F.col("html")).alias("content_hash"))
    return _covered(pages)


@query(f"SELECT 'f' || doc_id || (['.py', '.cs', '.ts', '.tsx', '.html', '.css'])[doc_id % 6 + 1] AS source_file, CAST(length(t) AS BIGINT) AS n, sha256(t) AS sha FROM (SELECT doc_id, regexp_replace(text, '{_BLANK}', '', 'g') AS t FROM documents) WHERE t <> ''")
def code_chunk_cover(spark, d):
    """All documents, taken as sources in six languages: no character is lost, whatever the parsers make of them."""
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".py", ".cs", ".ts", ".tsx", ".html", ".css"))), (F.col("doc_id") % 6 + 1).cast("int"))
    docs = _t(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), suffix).alias("source_file"), F.lit("docs").alias("repo_name"), F.col("text").alias("content"), content_hash(F.col("text")).alias("content_hash"))
    return _covered(docs)


@query()
def embed_hashing(spark, d):
    return _t(spark, d, "documents").select("doc_id", embed(HashingProvider(64), F.col("text")).alias("vector"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
