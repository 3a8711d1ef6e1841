"""Top-k search: full text, exact nearest neighbours, and both fused by reciprocal ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import vectors
from lorekeep.functions.embed import EmbeddingProvider
from lorekeep.operators import fts
from lorekeep.operators.filters import code_filter, notes_filter

MODES = ("text", "vector", "hybrid")
RRF_K = 60


def _text_hits(df: DataFrame, query: str, top_k: int, condition: Column | None, key: str, text: str, index: fts.Index | None) -> DataFrame:
    """key, score of the top_k rows; counts are of all rows, condition restricts the hits."""
    if index is None:
        hits = fts.bm25(df, query, key, text, condition)
    else:
        hits = fts.bm25_indexed(index, query, key)
        if condition is not None:
            hits = hits.join(df.where(condition).select(key), key, "left_semi")
    return hits.orderBy(F.desc("score"), key).limit(top_k)


def text_search(df: DataFrame, query: str, top_k: int = 10, condition: Column | None = None, key: str = "id", text: str = "text", index: fts.Index | None = None) -> DataFrame:
    """The top_k rows by BM25, with score and score_kind; ties by key. The vector is not read. index: of df's texts; without one all texts are read."""
    df = df.drop("vector")
    rows = df.join(F.broadcast(_text_hits(df, query, top_k, condition, key, text, index)), key)  # at most top_k rows
    return rows.withColumn("score_kind", F.lit("bm25")).orderBy(F.desc("score"), key)


def vector_search(df: DataFrame, query: Sequence[float], top_k: int = 10, condition: Column | None = None, metric: str = "l2", key: str = "id", vector: str = "vector") -> DataFrame:
    """The top_k rows of the least distance (exact scan), with score and score_kind, without the vector; ties by key.

    Rows with vectors of another length are left out. The scan keeps k rows a task, and k rows a task are all that moves.
    """
    d = vectors.distance(metric)(F.col(vector), vectors.literal(query))
    rows = (df if condition is None else df.where(condition)).where(F.size(vector) == len(query))
    return rows.withColumn("score", d).drop(vector).withColumn("score_kind", F.lit("distance")).orderBy("score", key).limit(top_k)


def vector_search_batch(df: DataFrame, queries: DataFrame, top_k: int = 10, key: str = "id", vector: str = "vector", block: int = 256) -> DataFrame:
    """query_id, key, score, rank for a table of queries (query_id, vector): exact squared distances in blocks of a matrix product.

    The queries must fit a broadcast (checked: 64 MB); each task keeps k rows a query, of which a window keeps the best.
    """
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    got = queries.select("query_id", vector).orderBy("query_id").limit(200_001).toArrow()
    if got.nbytes > 64 << 20 or got.num_rows > 200_000:
        raise ValueError("too many queries for one batch: split them")
    ids, q = got.column(0).to_pylist(), np.array(got.column(1).to_pylist(), np.float64)
    if not len(ids):
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {key} {dict(df.dtypes)[key]}, score double, rank int")
    sent = spark.sparkContext.broadcast((ids, q))
    kinds = dict(queries.dtypes)["query_id"], dict(df.dtypes)[key]

    def run(batches):
        ids, q = sent.value
        best_d, best_i = np.full((len(ids), top_k), np.inf), np.full((len(ids), top_k), None, object)
        kind = None
        unit = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps  # bounds the rounding of the expanded form, over both norms
        for b in batches:
            kind = b.column(0).type
            vs = b.column(1).to_pylist()
            ok = [i for i, v in enumerate(vs) if v is not None and len(v) == q.shape[1]]
            if not ok:
                continue
            names = b.column(0).to_pylist()
            ok.sort(key=lambda i: (names[i] is None, names[i]))  # so that a stable sort by distance leaves ties by key
            keys, x = np.array(names, object)[ok], np.array([vs[i] for i in ok], np.float64)
            x_norm, last = (x**2).sum(1), min(top_k, len(ok)) - 1
            for k in range(0, len(ids), block):
                s = slice(k, k + block)
                with np.errstate(over="ignore", invalid="ignore"):
                    near = (q[s] ** 2).sum(1)[:, None] - 2 * q[s] @ x.T + x_norm[None, :]
                    slack = unit * ((q[s] ** 2).sum(1)[:, None] + x_norm[None, :])
                    lower, kth = near - slack, np.partition(near + slack, last, 1)[:, last]
                for r in range(near.shape[0]):
                    # all rows that may be as near as the kth, ties included; where bounds are not numbers, all rows
                    most = min(kth[r], best_d[k + r, -1] * (1 + unit)) if np.isfinite(kth[r]) else np.inf
                    c = np.flatnonzero(~(lower[r] > most))
                    # differences squared, so that what is returned has no cancellation
                    d = ((x[c] - q[k + r]) ** 2).sum(1)
                    nearest = np.argsort(d, kind="stable")[:top_k]
                    d = np.concatenate([best_d[k + r], d[nearest]])
                    n = np.concatenate([best_i[k + r], keys[c[nearest]]])
                    order = sorted(range(len(d)), key=lambda i: (d[i], n[i] is None, n[i]))[:top_k]
                    best_d[k + r], best_i[k + r] = d[order], n[order]
        if kind is None:
            return
        keep = np.isfinite(best_d)
        rows = [(ids[i], best_i[i, j], best_d[i, j]) for i, j in zip(*np.nonzero(keep))]
        if rows:
            a, b_, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_, kind), pa.array(c)], names=["query_id", key, "score"])

    found = df.select(key, vector).mapInArrow(run, f"query_id {kinds[0]}, {key} {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy("score", key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def fuse(text_hits: DataFrame, vector_hits: DataFrame, top_k: int = 10, rrf_k: int = RRF_K, key: str = "id") -> DataFrame:
    """key, score, text_rank, vector_rank: the sum of 1 / (rrf_k + rank), ranks from 1; ties by text rank, then vector rank. Both sides are short ranked lists (key, rank)."""
    both = text_hits.select(key, F.col("rank").alias("text_rank")).join(vector_hits.select(key, F.col("rank").alias("vector_rank")), key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("text_rank") + part("vector_rank")).orderBy(F.desc("score"), F.asc_nulls_last("text_rank"), F.asc_nulls_last("vector_rank")).limit(top_k)


def _ranked(hits: DataFrame, order: list) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # over at most top_k rows


def hybrid_search(df: DataFrame, query: str, query_vector: Sequence[float], top_k: int = 10, condition: Column | None = None, rrf_k: int = RRF_K, metric: str = "l2", key: str = "id", text: str = "text", vector: str = "vector", index: fts.Index | None = None) -> DataFrame:
    """Both searches with one top_k and condition, fused."""
    t = _text_hits(df.drop(vector), query, top_k, condition, key, text, index)
    v = vector_search(df.select("*"), query_vector, top_k, condition, metric, key, vector).select(key, "score")
    fused = fuse(_ranked(t, [F.desc("score"), key]), _ranked(v, ["score", key]), top_k, rrf_k, key)
    rows = df.drop(vector).join(F.broadcast(fused), key)  # at most top_k rows
    return rows.withColumn("score_kind", F.lit("rrf")).orderBy(F.desc("score"), F.asc_nulls_last("text_rank"), F.asc_nulls_last("vector_rank")).drop("text_rank", "vector_rank")


def _dispatch(df, query, top_k, mode, condition, embedder, index=None, **how):
    """how: names of columns and what else the searches take."""
    if mode not in MODES:
        raise ValueError(f"Unsupported search mode: {mode!r}. Supported: {', '.join(MODES)}")
    if mode != "text" and embedder is None:
        raise ValueError(f"Search mode {mode!r} requires an embedder")
    if mode == "text":
        return text_search(df, query, top_k, condition, index=index, **how)
    v = embedder.embed_query(query)
    return vector_search(df, v, top_k, condition, **how) if mode == "vector" else hybrid_search(df, query, v, top_k, condition, index=index, **how)


def search_notes(notes: DataFrame, query: str, *, top_k: int = 10, mode: str = "text", project: str | None = None, session_id: str | None = None, tags: str | None = None, exact_tags: bool = False, embedder: EmbeddingProvider | None = None, **how) -> DataFrame:
    return _dispatch(notes, query, top_k, mode, notes_filter(project, session_id, tags, exact_tags), embedder, **how)


def search_code(code: DataFrame, query: str, *, top_k: int = 10, mode: str = "text", language: str | None = None, chunk_type: str | None = None, repo_name: str | None = None, embedder: EmbeddingProvider | None = None, **how) -> DataFrame:
    return _dispatch(code, query, top_k, mode, code_filter(language, chunk_type, repo_name), embedder, **how)


def find_similar(code: DataFrame, snippet: str, embedder: EmbeddingProvider, *, top_k: int = 10, language: str | None = None, repo_name: str | None = None, **how) -> DataFrame:
    return vector_search(code, embedder.embed_query(snippet), top_k, code_filter(language, None, repo_name), **how)


def search_everything(notes: DataFrame, code: DataFrame, query: str, *, top_k: int = 10, **how) -> DataFrame:
    """kind, id, text, source_file, score: notes and code, fused by reciprocal ranks of their own lists."""
    parts = []
    for kind, hits in (("note", search_notes(notes, query, top_k=top_k, **how)), ("code", search_code(code, query, top_k=top_k, **how))):
        order = [F.asc("score") if how.get("mode") == "vector" else F.desc("score"), F.col("id")]
        parts.append(_ranked(hits, order).select(F.lit(kind).alias("kind"), "id", "text", "source_file", (1.0 / (RRF_K + F.col("rank"))).alias("score")))
    return parts[0].unionByName(parts[1]).orderBy(F.desc("score"), F.desc("kind"), "id").limit(top_k)
