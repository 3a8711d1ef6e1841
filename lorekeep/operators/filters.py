"""Predicates over notes and code. They are columns, so values need no escaping and reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def notes_filter(project: str | None = None, session_id: str | None = None, tags: str | None = None, exact_tags: bool = False) -> Column | None:
    """All of the given ones; tags: comma-separated, each within the stored list (as LIKE, or exact_tags: as a whole tag)."""
    out = [F.col(k) == v for k, v in (("project", project), ("session_id", session_id)) if v]
    for t in (x.strip() for x in (tags or "").split(",")):
        if t:
            out.append(F.array_contains(F.split("tags", r"\s*,\s*"), t) if exact_tags else F.col("tags").like(f"%{t}%"))
    return _all(out)


def code_filter(language: str | None = None, chunk_type: str | None = None, repo_name: str | None = None) -> Column | None:
    return _all([F.col(k) == v for k, v in (("language", language), ("chunk_type", chunk_type), ("repo_name", repo_name)) if v])
