"""What the operators of this subpackage share: reading tables, cutting lineage, folds."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import traceback
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: bound a Python worker's memory where texts are very long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Whether Spark deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def cut(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and returns the table: lineage ends there, and a lost executor costs nothing.

    free: what the writing shuffled is deleted at its end, not when the driver's memory is next collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lorekeep_path = path
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """df if it only scans, filters and projects tables, so that each pass over it meets the same rows in the same order; else a table of it."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        p = plans.pop()
        if p.nodeName().split(" ")[0] not in ("Project", "Filter", "LogicalRelation", "Relation", "DataSourceV2ScanRelation", "RelationV2", "LocalRelation", "Range") or not p.deterministic():
            return cut(df, name)
        plans += [p.children().apply(i) for i in range(p.children().size())]
    return df


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by cut() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._lorekeep_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def trim() -> None:
    """Gives freed memory of this process back to the system, where the C library can: workers live on after a task."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def trimmed(batches):
    """The batches; what their making took is given back at their end."""
    yield from batches
    trim()


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, mod n; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """text, lk_y of labelled rows outside the held-out fifth: of each label value at most so many, those of the least hash of the id.

    Null labels and null texts are left out; of several labels of one id the largest counts, of several texts the least.
    Only ids meet in the top-n; texts come by a join with at most sum(most) broadcast ids. The rows lie in one partition,
    by id, for a task to learn from.
    """
    rows = (
        labels.select(F.col("doc_id").alias("lk_id"), F.col(label).alias("lk_y"))
        .where(F.col("lk_id").isNotNull() & F.col("lk_y").isNotNull() & (crc_mod("lk_id", 5) != 0))
        .groupBy("lk_id").agg(F.max("lk_y").cast("int").alias("lk_y"))
    )
    picked = None
    for value, n in most.items():
        part = rows.where(F.col("lk_y") == value).orderBy(F.xxhash64(F.col("lk_id").cast("string")), "lk_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.select(F.col("doc_id").alias("lk_id"), "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(picked), "lk_id").groupBy("lk_id").agg(F.max("lk_y").alias("lk_y"), F.min("text").alias("text"))
    return found.repartition(1).sortWithinPartitions("lk_id").select("text", "lk_y")


def fitted(sample: DataFrame, fit) -> bytes:
    """What fit, given (text, label) of a bounded sample one after the other, returns. It runs in one task, so the driver holds no text, and there in a process of its own, whose memory ends with it."""

    def run(batches):
        rows = [(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([_apart(fit, rows)], pa.binary())], names=["model"])

    rows = sample.mapInArrow(run, "model binary").collect()
    return bytes(rows[0].model) if rows else fit([])


def _apart(f, x) -> bytes:
    """f(x), computed by a fork of this process; an error there is raised here."""
    out, into = os.pipe()
    child = os.fork()
    if not child:
        code = 1
        try:
            os.close(out)
            try:
                data = b"+" + f(x)
            except BaseException:
                data = b"-" + traceback.format_exc().encode()
            with os.fdopen(into, "wb") as w:
                w.write(data)
            code = 0
        finally:
            os._exit(code)
    os.close(into)
    with os.fdopen(out, "rb") as r:
        data = r.read()
    os.waitpid(child, 0)
    if data[:1] != b"+":
        raise RuntimeError(data[1:].decode() or "the fitting process ended early")
    return data[1:]


def hot_bound(table: DataFrame, most: int) -> tuple[int, bool]:
    """The least count from which on there are at most so many words, and whether rarer words exist."""
    steps = table.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("s")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()
    total, bound, rest = 0, 1 << 62, False
    for r in sorted(steps, key=lambda r: -r.s):
        if total + r.c > most:
            rest = True
            break
        total, bound = total + r.c, r.least
    return bound, rest
