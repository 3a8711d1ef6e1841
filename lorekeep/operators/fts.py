"""Full-text search: an inverted index as tables, stored by buckets of terms, and BM25 over it or, without one, over texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import terms
from lorekeep.operators.store import Snapshot

K1, B = 1.2, 0.75
#: Folders that stored postings are dealt into by term; a query reads those of its terms. Parts of a bucket, as one term may hold many of all postings.
BUCKETS, PARTS = 64, 4


@dataclass(frozen=True)
class Index:
    """postings(term, id, tf, dl), corpus(n, avgdl): one row. stored: whether postings have a bucket column that folders go by."""

    postings: DataFrame
    corpus: DataFrame
    stored: bool = False


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counts(df: DataFrame, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """postings (term, id, tf, dl) and lengths (id, dl). A document's term counts are made within its row, from the runs of its sorted words: one row for each (term, document) leaves the scan and no shuffle is needed."""
    rows = df.select(F.col(key).alias("id"), F.sort_array(terms(F.coalesce(F.col(text), F.lit("")))).alias("ws"))
    places = F.when(F.size("ws") > 0, F.sequence(F.lit(1), F.size("ws"))).otherwise(F.array().cast("array<int>"))
    runs = rows.select("id", "ws", F.filter(places, lambda i: (i == 1) | (F.get(F.col("ws"), i - 1) != F.get(F.col("ws"), i - 2))).alias("runs"))
    each = F.transform("runs", lambda p, k: F.struct(F.get(F.col("ws"), p - 1).alias("term"), (F.coalesce(F.get(F.col("runs"), k + 1), F.size("ws") + 1) - p).alias("tf")))
    postings = runs.select("id", F.size("ws").cast("long").alias("dl"), F.explode(each).alias("p")).select("p.term", "id", F.col("p.tf").cast("long").alias("tf"), "dl")
    return postings, rows.select("id", F.size("ws").cast("long").alias("dl"))


def build(df: DataFrame, key: str = "id", text: str = "text") -> Index:
    """An index that is made as it is read."""
    postings, lengths = counts(df, key, text)
    return Index(postings, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def by_bucket(postings: DataFrame) -> DataFrame:
    """Postings ready to be stored in folders by bucket, each in a few sorted files, so that scans skip other terms."""
    n = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = postings.withColumn("bucket", bucket(F.col("term")))
    return rows.repartition(n, "bucket", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("bucket", "term")


def stored(now: Snapshot, name: str) -> Index | None:
    """The index that commits keep beside a table: tables name_postings and name_corpus (n, total)."""
    postings, corpus = now.rows(f"{name}_postings"), now.rows(f"{name}_corpus")
    if postings is None or corpus is None:
        return None
    return Index(postings, corpus.select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl")), stored=True)


def query_terms(query: str) -> list[str]:
    """The query's distinct terms, by the analyzer of the documents."""
    import unicodedata

    out, word = [], []
    for ch in query.lower() + " ":
        if unicodedata.category(ch)[0] in "LN":
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return list(dict.fromkeys(out))


def _score(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(df: DataFrame, query: str, key: str = "id", text: str = "text", condition: Column | None = None) -> DataFrame:
    """key, score of the documents with any term of the query, in one scan; counts are of the whole table, condition restricts the hits.

    Only the query's terms are counted, within the row: nothing is exploded, and one small aggregate crosses the network.
    """
    words = query_terms(query)
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    if not words:
        return spark.createDataFrame([], f"{key} {kind}, score double")
    rows = df.select(key, (F.lit(True) if condition is None else condition).alias("ok"), terms(F.coalesce(F.col(text), F.lit(""))).alias("ws"))
    tf = F.array(*(F.size("ws") - F.size(F.array_remove("ws", w)) for w in words))
    rows = rows.select(key, "ok", F.size("ws").alias("dl"), tf.alias("tf"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(words)))).alias("df"))
    # a row that has no hit yields none here; a filter would be pushed below and split the text again
    hit = F.when(F.coalesce("ok", F.lit(False)) & F.exists("tf", lambda x: x > 0), F.array(F.struct("dl", "tf")))
    hits = rows.select(key, F.explode(hit).alias("h")).crossJoin(F.broadcast(stats))  # one row of counts
    parts = [F.when(F.col("h.tf")[i] > 0, _score(F.col("h.tf")[i], F.col("h.dl"), F.col("df")[i], F.col("n"), F.col("avgdl"))).otherwise(0.0) for i in range(len(words))]
    return hits.select(key, sum(parts, F.lit(0.0)).alias("score"))


def _wanted(index: Index, words: list[str]) -> DataFrame:
    """Postings of a few terms; of a stored index only their folders are read, and there the row groups that may have them."""
    found = index.postings.where(F.col("term").isin(*words))
    if index.stored:
        spark = found.sparkSession
        own = spark.range(1).select(F.array(*(bucket(F.lit(w)) for w in words)).alias("b")).first().b
        found = found.where(F.col("bucket").isin(*sorted(set(own))))
    return found


def bm25_indexed(index: Index, query: str, key: str = "id") -> DataFrame:
    """key, score of the documents with any term of the query, over an index."""
    words = query_terms(query)
    if not words:
        return index.postings.select(F.col("id").alias(key), F.lit(0.0).alias("score")).limit(0)
    found = _wanted(index, words)
    freq = found.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    hits = found.join(F.broadcast(freq), "term").crossJoin(F.broadcast(index.corpus))  # one row of counts
    s = _score(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return hits.groupBy("id").agg(F.sum(s).alias("score")).withColumnRenamed("id", key)


def search(index: Index, queries: DataFrame, key: str = "id") -> DataFrame:
    """query_id, key, score for a table of queries (query_id, query) over an index: a join on terms.

    Document frequencies are joined to the queries' terms, which are few, before the postings; adaptive execution splits
    the postings of a frequent term.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    vocabulary = wanted.select("term").distinct()
    on = ["term"]
    if index.stored:  # the folders of buckets without a query's term are left out as the join runs
        on, vocabulary, wanted = ["bucket", "term"], vocabulary.withColumn("bucket", bucket(F.col("term"))), wanted.withColumn("bucket", bucket(F.col("term")))
    found = index.postings.join(vocabulary, on, "left_semi")
    freq = found.groupBy(*on).agg(F.count("*").alias("df"))
    hits = found.join(wanted.join(freq, on), on).crossJoin(F.broadcast(index.corpus))  # one row
    s = _score(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return hits.groupBy("query_id", "id").agg(F.sum(s).alias("score")).withColumnRenamed("id", key)
