"""Operator 1: exact top-k search by Fagin's threshold algorithm over sorted lists of each dimension.

Vectors are dealt into shards; a shard sorts each dimension's values once. A query walks all lists from the side that
its weight prefers; vectors seen in any list are scored in full, and the walk ends when the sum of weight times the
value reached in each list, the most that an unseen vector can score, cannot beat the kth result. The shards' results
meet in a top-k for each query, of which each task keeps k rows before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, small_batches

#: Vectors in a shard.
SHARD = 8192
#: Lists advance by this many places in a first round, and by twice as many in each further one.
STEP = 32


class Lists:
    """A shard's vectors, integers, with the order of each dimension's values."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], np.ascontiguousarray(x[by])
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, self.order, 0)
        self.most = int(abs(self.x).max())
        self.f = self.x.astype(np.float64)

    def search(self, q: np.ndarray, own: object, k: int) -> list[tuple[int, int]]:
        """(score, place) of the k best, ties to smaller ids, without id own."""
        n = len(self.ids)
        # whole numbers below 2 ** 53 are exact in doubles; larger ones are summed as Python's
        small = self.most * int(abs(q).max()) * len(q) < 1 << 53
        up = q > 0
        used = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        scores, places = np.zeros(0, np.float64 if small else object), np.zeros(0, np.int64)
        depth, step, w = 0, STEP, q.astype(np.float64 if small else object)
        while depth < n:
            reach = min(n, depth + step)
            if not len(used):
                fresh, reach = np.arange(n), n
            else:
                rows = np.where(up[used], n - 1 - np.arange(depth, reach)[:, None], np.arange(depth, reach)[:, None])
                new = np.zeros(n, bool)
                new[self.order[rows, used[None, :]]] = True
                fresh = np.flatnonzero(new & ~seen)
            seen[fresh] = True
            s = self.f[fresh] @ w if small else self.x[fresh].astype(object) @ w
            ok = self.ids[fresh] != own
            scores, places = np.concatenate([scores, s[ok]]), np.concatenate([places, fresh[ok]])
            if len(scores) > k:
                best = np.lexsort((self.ids[places], -scores))[:k]
                scores, places = scores[best], places[best]
            depth, step = reach, step * 2
            if depth < n:
                edge = self.sorted[np.where(up[used], n - depth, depth - 1), used]
                # an unseen vector is at most at the last value passed in each list; a tie could still win by its id
                if len(scores) == k and edge.astype(w.dtype) @ w[used] < scores.min():
                    break
        best = np.lexsort((self.ids[places], -scores))
        return [(int(scores[i]), int(places[i])) for i in best]


def _usable(df: DataFrame) -> DataFrame:
    """Without vectors that are null or hold null or non-finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of the largest integer inner product, ties to the smaller id.

    Both have vec_id and embedding; a component x counts as floor(scale * x). Vectors that are null, empty, without id,
    or hold null or non-finite components take no part; a candidate with the query's own id is left out; of repeated
    candidate ids one counts (the least vector); vectors of other lengths than the query's are not compared with it.
    Fewer than k candidates give fewer rows; extra columns are ignored.
    """
    spark = candidates.sparkSession
    small_batches(spark)

    def whole(df):
        rows = _usable(df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")))
        rows = rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")).where(F.size("v") > 0)
        return rows.groupBy("id").agg(F.min("v").alias("v"))

    cand, qs = cut(whole(candidates), "vectors"), cut(whole(queries), "queries")
    n = cand.count()
    shards = max(1, -(-n // SHARD))
    left = qs.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"))
    right = cand.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"))
    dealt = left.unionByName(right)

    def run(batches):
        shard, rows, ids, lists, out = None, [], [], None, []

        def ready():
            by = {}
            for i, v in zip(ids, rows):
                by.setdefault(len(v), []).append((i, v))
            return {m: Lists(np.array([i for i, _ in vs], np.int64), np.array([v for _, v in vs], np.int64)) for m, vs in by.items()}

        def batch():
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

        for b in batches:
            vs = b.column(1)
            for i, v, s, q in zip(b.column(0).to_pylist(), vs.to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if s != shard:
                    shard, rows, ids, lists = s, [], [], None
                if not q:
                    ids.append(i), rows.append(v)
                    continue
                if lists is None:
                    lists = ready()
                own = lists.get(len(v))
                if own is not None:
                    out += [(i, int(own.ids[place]), score) for score, place in own.search(np.array(v, np.int64), i, k)]
            if len(out) > 5000:
                yield batch()
                out = []
        if out:
            yield batch()

    n_out = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(n_out, "shard").sortWithinPartitions("shard", "query", "id").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
