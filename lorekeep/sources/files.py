"""Sources of files. Spark's own readers skip names that begin with _ or ., so walks are Python data sources."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lorekeep import schemas

#: Folders that hold no source of their own, the size beyond which a file is skipped, and languages by suffix.
SKIP_DIRS = frozenset((".git", "node_modules", "__pycache__", ".venv", "venv", "vendor", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache"))
MAX_FILE_SIZE, SNIFF = 100_000, 8192
LANGUAGES = {".py": "python", ".cs": "csharp", ".ts": "typescript", ".tsx": "tsx", ".html": "html", ".htm": "html", ".css": "css"}
INCLUDE, EXCLUDE = ("*.md",), (".obsidian/*", ".trash/*", "templates/*")


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix)


def wanted(rel: str, include=INCLUDE, exclude=EXCLUDE) -> bool:
    """Excluding patterns win; patterns match the last parts of a path."""
    p = PurePath(rel)
    return not any(p.match(x) for x in exclude) and any(p.match(x) for x in include)


class Ignore:
    """Patterns of a .gitignore at a project's root: the last that matches decides, ! takes back, / anchors, a trailing / means folders."""

    def __init__(self, text: str):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            out, i, p = "", 0, line.lstrip("/")
            while i < len(p):
                if p.startswith("**/", i):
                    out, i = out + "(?:.*/)?", i + 3
                elif p.startswith("/**", i) and i + 3 == len(p):
                    out, i = out + "/.*", i + 3
                elif p[i] == "*":
                    while p[i : i + 1] == "*":
                        i += 1
                    out += "[^/]*"
                elif p[i] == "[" and "]" in p[i + 2 :]:
                    k = p.index("]", i + 2)
                    out, i = out + "[" + p[i + 1 : k].replace("!", "^", 1).replace("\\", "\\\\") + "]", k + 1
                else:
                    out, i = out + ("[^/]" if p[i] == "?" else re.escape(p[i])), i + 1
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + out + ("/.*" if only_dir else "(?:/.*)?") + r"\Z", re.S), keep))

    def __call__(self, rel: str) -> bool:
        ignored = False
        for pattern, keep in self.rules:
            if pattern.match(rel):
                ignored = not keep
        return ignored


def binary(head: bytes) -> bool:
    return b"\0" in head[:SNIFF]


def discover_dirs(paths: list[str]) -> list[str]:
    """Of each path its visible, unskipped subfolders, or itself if it has none; missing ones are left out."""
    out = []
    for p in map(Path, paths):
        if p.is_dir():
            subs = sorted(d for d in p.iterdir() if d.is_dir() and not d.name.startswith(".") and d.name not in SKIP_DIRS)
            out += [str(d) for d in subs] or [str(p)]
    return list(dict.fromkeys(out))


class _Files(InputPartition):
    def __init__(self, root: str, top: str, alone: bool):
        self.root, self.top, self.alone = root, top, alone


class _Reader(DataSourceReader):
    """A partition for the files right in a root and one for each folder in it, so that a large tree is read by many tasks."""

    def __init__(self, roots: list[str], check):
        self.roots, self.check = roots, check

    def partitions(self):
        out = []
        for r in self.roots:
            if os.path.isdir(r):
                out.append(_Files(r, r, True))
                out += [_Files(r, e.path, False) for e in sorted(os.scandir(r), key=lambda e: e.name) if e.is_dir() and e.name not in SKIP_DIRS]
        return out

    def read(self, part: _Files) -> Iterator[tuple]:
        ignore_file = Path(part.root, ".gitignore")
        ignore = Ignore(ignore_file.read_text("utf-8", "replace")) if ignore_file.is_file() else None
        for d, subs, names in os.walk(part.top):
            subs[:] = [] if part.alone else sorted(s for s in subs if s not in SKIP_DIRS)
            for n in sorted(names):
                path = Path(d, n)
                rel = path.relative_to(part.root).as_posix()
                if not path.is_file() or not self.check(rel, path, ignore):
                    continue
                try:
                    data = path.read_bytes()
                except OSError:
                    continue
                yield (str(path), rel, Path(part.root).name, len(data), data.decode("utf-8", "replace"), "sha256:" + hashlib.sha256(data).hexdigest())


class _Source(DataSource):
    def schema(self):
        return schemas.SOURCES

    def _roots(self) -> list[str]:
        return self.options["paths"].split("\n")


class VaultSource(_Source):
    """Notes below folders, by patterns (options paths, include, exclude: one a line)."""

    @classmethod
    def name(cls):
        return "markdown_vault"

    def reader(self, schema):
        inc = self.options.get("include", "\n".join(INCLUDE)).split("\n")
        exc = self.options.get("exclude", "\n".join(EXCLUDE)).split("\n")
        return _Reader(self._roots(), lambda rel, path, ignore: wanted(rel, inc, exc))


class RepoSource(_Source):
    """Source files of projects: known suffix, not ignored, not large, not binary; cheap checks come first."""

    @classmethod
    def name(cls):
        return "source_repos"

    def reader(self, schema):
        def check(rel: str, path: Path, ignore) -> bool:
            if path.suffix.lower() not in LANGUAGES or (ignore and ignore(rel)):
                return False
            try:
                if path.stat().st_size > MAX_FILE_SIZE:
                    return False
                with path.open("rb") as f:
                    return not binary(f.read(SNIFF))
            except OSError:
                return False

        return _Reader(self._roots(), check)


@dataclass
class _Written(WriterCommitMessage):
    """A task's folder of bodies and the paths they are for."""

    folder: str
    paths: list[str]


class _NoteWriter(DataSourceWriter):
    """Tasks write bodies into folders of their own; only what the commit is given becomes notes, so a task that runs twice counts once. The root must be a folder that driver and executors share."""

    def __init__(self, root: str, append: bool):
        self.root, self.append = root, append

    def write(self, rows):
        folder, paths = Path(self.root, f".lk-{uuid.uuid4().hex}"), []
        folder.mkdir(parents=True)
        for r in rows:
            Path(folder, str(len(paths))).write_text(r.body, "utf-8")
            paths.append(r.rel_path)
        return _Written(str(folder), paths)

    def commit(self, messages):
        for m in messages:
            if m is None:
                continue
            for k, rel in enumerate(m.paths):
                path, body = Path(self.root, rel), Path(m.folder, str(k))
                path.parent.mkdir(parents=True, exist_ok=True)
                if self.append and path.exists():
                    body.write_text(path.read_text("utf-8") + body.read_text("utf-8"), "utf-8")
                body.replace(path)
        self.abort(messages)

    def abort(self, messages):
        for m in messages:
            if m is not None:
                shutil.rmtree(m.folder, ignore_errors=True)


class NoteSink(DataSource):
    """Writes (rel_path, body) as files below option root, when all tasks are done; mode append adds to existing ones."""

    @classmethod
    def name(cls):
        return "markdown_notes"

    def schema(self):
        return "rel_path string, body string"

    def writer(self, schema, overwrite):
        return _NoteWriter(self.options["root"], not overwrite)


def register(spark: SparkSession) -> None:
    for s in (VaultSource, RepoSource, NoteSink):
        spark.dataSource.register(s)


def vault(spark: SparkSession, paths: list[str], include=INCLUDE, exclude=EXCLUDE) -> DataFrame:
    register(spark)
    return spark.read.format("markdown_vault").options(paths="\n".join(paths), include="\n".join(include), exclude="\n".join(exclude)).load()


def repos(spark: SparkSession, paths: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("source_repos").option("paths", "\n".join(discover_dirs(paths))).load()


def write_notes(df: DataFrame, root: str, append: bool = False) -> None:
    register(df.sparkSession)
    df.select("rel_path", "body").write.format("markdown_notes").option("root", root).mode("append" if append else "overwrite").save()
