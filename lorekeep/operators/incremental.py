"""Indexing of what changed: files are compared with the last commit by hash, and all tables change in one commit.

A commit adds segments with the changed files' chunks, postings and hashes, and lists the files whose older rows are gone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.functions.embed import EmbeddingProvider, embed, zero_vector
from lorekeep.functions.text import terms
from lorekeep.operators import fts
from lorekeep.operators.codechunk import chunk_sources
from lorekeep.operators.markdown import chunk_notes
from lorekeep.operators.store import Changes, Snapshot, Store


#: A table of more segments is written as one.
MOST_SEGMENTS = 24


class Done(NamedTuple):
    files: int
    chunks: int
    removed: int


def changed(scan: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """Rows of scan that index (source_file, content_hash) lacks or has with another hash."""
    old = index.select("source_file", F.col("content_hash").alias("lk_old"))
    rows = scan.join(old, "source_file", "left")
    return (rows if force else rows.where(~F.col("content_hash").eqNullSafe(F.col("lk_old")))).drop("lk_old")


def stale(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of index whose file is gone."""
    return index.join(scan.select("source_file"), "source_file", "left_anti")


def _with_vectors(chunks: DataFrame, provider: EmbeddingProvider | None, text) -> DataFrame:
    return chunks.withColumn("vector", zero_vector(schemas.DEFAULT_DIM) if provider is None else embed(provider, text))


def _index(store: Store, name: str, schema, scan: DataFrame, chunk, provider, force: bool, within: str | None = None) -> Done:
    done = Done(0, 0, 0)

    def make(now: Snapshot) -> Changes | None:
        nonlocal done
        index = now.table(f"{name}_files", schemas.FILE_INDEX)
        scope = index if within is None else index.where(F.col("source_file").startswith(within.rstrip("/") + "/"))
        # of each file path, hash and what is to be done; contents are read again where they are chunked
        new, gone = changed(scan, index, force), stale(scan, scope)
        touched = new.select("source_file", "content_hash").unionByName(gone.select("source_file", F.lit(None).cast("string").alias("content_hash")))
        touched = store.scratch(touched, f"{name}-touched")
        n_files, n_gone = touched.agg(F.count("content_hash"), F.count_if(F.col("content_hash").isNull())).first()
        if not n_files and not n_gone:
            done = Done(0, 0, 0)
            return None
        fresh = touched.where("content_hash is not null")
        chunks = store.scratch(_with_vectors(*chunk(scan.join(fresh, ["source_file", "content_hash"], "left_semi"), provider)).select(*schema.names), f"{name}-chunks")
        postings, _ = fts.counts(chunks)
        postings = postings.join(chunks.select("id", "source_file"), "id")
        # n and total: what the touched files had goes, what the new chunks have comes
        length = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(terms(F.col("text")))), F.lit(0)).alias("total")).first()
        had = length(now.table(name, schema).join(touched.select("source_file"), "source_file", "left_semi"))
        has, before = length(chunks), now.rows(f"{name}_corpus")
        n, total = before.first() if before is not None else (0, 0)
        corpus = store.spark.range(1).select(F.lit(n - had.n + has.n).cast("long").alias("n"), F.lit(total - had.total + has.total).cast("long").alias("total"))
        with_chunks = chunks.select(F.countDistinct("source_file")).first()[0]
        done = Done(with_chunks if name == "code" else n_files, has.n, n_gone)
        out = ("source_file", touched)
        return Changes(
            replace={f"{name}_corpus": corpus},
            append={name: chunks, f"{name}_files": fresh, f"{name}_postings": fts.by_bucket(postings)},
            gone={name: out, f"{name}_files": out, f"{name}_postings": out},
            partition_by={f"{name}_postings": ["bucket"]},
        )

    store.transact(make)
    for table, by in ((name, None), (f"{name}_files", None), (f"{name}_postings", ["bucket"])):
        if len(store.now().tables.get(table, {}).get("segments", ())) > MOST_SEGMENTS:
            store.compact(table, by)
    return done


def index_notes(store: Store, scan: DataFrame, provider: EmbeddingProvider | None = None, force: bool = False, within: str | None = None) -> Done:
    """scan: rows of the vault. A changed note's old chunks go; deleted notes go. Several notes of equal bytes keep their own chunks."""
    return _index(store, "notes", schemas.NOTES, scan, lambda new, p: (chunk_notes(new), p, F.col("text")), provider, force, within)


def index_code(store: Store, scan: DataFrame, provider: EmbeddingProvider | None = None, force: bool = False, within: str | None = None) -> Done:
    """scan: source files; within: only files below this folder can be stale (a sibling of the same beginning isn't)."""

    def chunk(new, p):
        text = F.when(F.col("context_header") != "", F.concat_ws("\n", "context_header", "text")).otherwise(F.col("text"))
        return chunk_sources(new), p, text

    return _index(store, "code", schemas.CODE, scan, chunk, provider, force, within)
