"""Versioned tables: a commit writes new Parquet and then replaces a pointer, so a reader sees whole versions only.

A table is a list of segments. Most commits add one with the rows that are new, and lists of the files or ids whose older
rows are gone; what a commit costs follows what changed, not what is stored. compact() writes one segment again.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of new replace rows of old with their keys; new has one row a key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def last_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the one that comes last in the order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return df.withColumn("lk_n", F.row_number().over(w)).where("lk_n = 1").drop("lk_n")


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


class Conflict(RuntimeError):
    """Other writers were faster each time."""


@dataclass
class Changes:
    """What a commit does: tables written anew (None drops one), segments added, and (column, values) whose rows in older segments are gone."""

    replace: dict[str, DataFrame | None] = field(default_factory=dict)
    append: dict[str, DataFrame] = field(default_factory=dict)
    gone: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    partition_by: dict[str, list[str]] = field(default_factory=dict)


class Snapshot:
    """Tables as they stand in one manifest: {version, tables: {name: {segments: [[folder, version, schema]], gone: [[column, folder, version, schema]]}}}."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.version, self.tables = spark, root, manifest.get("version", 0), manifest.get("tables", {})

    def exists(self, name: str) -> bool:
        return name in self.tables

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        """The table's rows; empty if there is none, or if its columns lack one of the schema's."""
        out = self.rows(name)
        if out is None or set(schema.names) - set(out.columns):
            return self.spark.createDataFrame([], schema)
        return out.select(*schema.names, *(c for c in out.columns if c not in schema.names))

    def rows(self, name: str) -> DataFrame | None:
        """Rows of all segments but those that a later commit took away."""
        state = self.tables.get(name)
        if not state or not state["segments"]:
            return None

        def read(path, version, schema):
            return self.spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{self.root}/{path}").withColumn("lk_version", F.lit(version))

        out = read(*state["segments"][0])
        for segment in state["segments"][1:]:
            out = out.unionByName(read(*segment), allowMissingColumns=True)
        first, gone = min(x[1] for x in state["segments"]), {}
        for column, path, v, schema in state.get("gone", []):
            if v > first:
                gone.setdefault(column, []).append(read(path, v, schema))
        for column, lists in gone.items():
            last = lists[0]
            for x in lists[1:]:
                last = last.unionByName(x)
            last = last.groupBy(F.col(column).alias("lk_gone")).agg(F.max("lk_version").alias("lk_until"))
            out = out.join(last, (F.col(column) == F.col("lk_gone")) & (F.col("lk_version") < F.col("lk_until")), "left_anti")
        return out.drop("lk_version")

    def count(self, name: str) -> int:
        rows = self.rows(name)
        return 0 if rows is None else rows.count()


class Store:
    """Tables below a root that Spark's file systems reach. Writers work side by side; a commit that read an older version than it would follow is made again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def manifest(self) -> dict:
        """A manifest that is no JSON counts as none."""
        try:
            return json.loads(self._read("manifest.json") or "{}")
        except ValueError:
            return {}

    def now(self) -> Snapshot:
        return Snapshot(self.spark, self.root, self.manifest())

    @contextmanager
    def lock(self, patience: float = 5.0, stale: float = 60.0):
        """Exclusive: creates a file that must not exist. It is held while the manifest is replaced, never while data are written, so one that is old has no holder."""
        path, until = self._path("commit.lock"), time.time() + patience
        self._fs.mkdirs(self._path(""))
        while not self._try_create(path):
            status = self._fs.getFileStatus(path) if self._fs.exists(path) else None
            if status is not None and time.time() - status.getModificationTime() / 1000 > stale:
                self._fs.delete(path, False)
            elif time.time() > until:
                raise TimeoutError(f"{self.root} is locked by another writer")
            else:
                time.sleep(0.05)
        try:
            yield
        finally:
            self._fs.delete(path, False)

    def _try_create(self, path) -> bool:
        try:
            self._fs.create(path, False).close()
            return True
        except Exception:
            return False

    def _written(self, name: str, df: DataFrame, partition_by: list[str] | None) -> str:
        folder = f"{name}/v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def _flip(self, tables: dict, version: int) -> bool:
        """Replaces the manifest by one of the version after this, unless another writer has."""
        with self.lock():
            if self.manifest().get("version", 0) != version:
                return False
            temp = self._path(f"manifest-{uuid.uuid4().hex}.tmp")
            stream = self._fs.create(temp, True)
            stream.write(bytearray(json.dumps({"version": version + 1, "tables": tables}).encode()))
            stream.close()
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
            array = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            array[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context.rename(temp, self._path("manifest.json"), array)
            return True

    def transact(self, make: Callable[[Snapshot], Changes | None], tries: int = 8) -> None:
        """Commits what make returns for the present tables; if another writer commits meanwhile, make is asked again. None changes nothing."""
        for _ in range(tries):
            now = self.now()
            changes = make(now)
            if changes is None:
                return
            tables, version = json.loads(json.dumps(now.tables)), now.version + 1
            for name, df in changes.replace.items():
                if df is None:
                    tables.pop(name, None)
                else:
                    tables[name] = {"segments": [[self._written(name, df, changes.partition_by.get(name)), version, df.schema.jsonValue()]], "gone": []}
            lists: dict[int, list] = {}
            for name, (column, values) in changes.gone.items():
                if name in tables:
                    if id(values) not in lists:  # one list may serve several tables
                        values_ = values.select(column).distinct()
                        lists[id(values)] = [self._written(f"{name}_gone", values_, None), version, values_.schema.jsonValue()]
                    tables[name]["gone"].append([column, *lists[id(values)]])
            for name, df in changes.append.items():
                tables.setdefault(name, {"segments": [], "gone": []})["segments"].append([self._written(name, df, changes.partition_by.get(name)), version, df.schema.jsonValue()])
            if self._flip(tables, now.version):
                return
        raise Conflict(f"{self.root}: {tries} commits were overtaken")

    def commit(self, tables: dict[str, DataFrame | None], partition_by: dict[str, list[str]] | None = None) -> None:
        """Writes new versions of all tables (None drops one) in one commit, whatever they held before."""
        self.transact(lambda _: Changes(replace=tables, partition_by=partition_by or {}))

    def exists(self, name: str) -> bool:
        return self.now().exists(name)

    def table(self, name: str, schema: T.StructType) -> DataFrame:
        return self.now().table(name, schema)

    def count(self, name: str) -> int:
        return self.now().count(name)

    def upsert(self, name: str, rows: DataFrame, schema: T.StructType, key: str = "id") -> None:
        """Adds a segment; older rows with its keys are gone. Of several new rows with one key any one stays."""
        if not rows.isEmpty():
            new = rows.select(*schema.names).dropDuplicates([key])
            self.transact(lambda _: Changes(append={name: new}, gone={name: (key, new)}))

    def delete_ids(self, name: str, ids: Iterable[str], schema: T.StructType, key: str = "id") -> None:
        ids = list(ids)
        if ids:
            gone = self.spark.createDataFrame([(i,) for i in ids], f"{key} string")
            self.transact(lambda now: Changes(gone={name: (key, gone)}) if now.exists(name) else None)

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that no manifest names: lineage ends there, and vacuum() deletes it."""
        path = f"{self.root}/{self._written(name, df, None)}"
        return self.spark.read.schema(df.schema).parquet(path)

    def compact(self, name: str, partition_by: list[str] | None = None) -> None:
        """Writes the table's rows as one segment."""
        make = lambda now: Changes(replace={name: now.rows(name)}, partition_by={name: partition_by or []}) if now.exists(name) else None
        self.transact(make)

    def drop(self, name: str) -> None:
        self.transact(lambda now: Changes(replace={name: None}) if now.exists(name) else None)

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Deletes folders that the manifest doesn't name and that are old enough; how many. A running commit's folders are younger than older_than."""
        kept = {p for t in self.now().tables.values() for p in [*(s[0] for s in t["segments"]), *(g[1] for g in t["gone"])]}
        n = 0
        for name in [s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory()]:
            for s in self._fs.listStatus(self._path(name)):
                if f"{name}/{s.getPath().getName()}" not in kept and time.time() - s.getModificationTime() / 1000 > older_than:
                    n += bool(self._fs.delete(s.getPath(), True))
        return n


def default_root() -> str:
    return os.path.join(os.path.expanduser("~"), ".lorekeep", "store")


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, of this application: below spark.checkpoint.dir or the warehouse."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{d.rstrip('/')}/lorekeep-{spark.sparkContext.applicationId}"
