"""Column functions on text: hashing, stripping, truncation, analysis, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of letters and digits of any script.
NOT_WORD = r"[^\p{L}\p{N}]+"


def content_hash(c: Column) -> Column:
    """sha256:<hex> of text or bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; trim() takes spaces alone."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def truncate(c: Column, n: int = 200) -> Column:
    """The first n code points and three dots, if there are more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def preview(c: Column, n: int) -> Column:
    """One line of at most n code points, with three dots if cut."""
    return F.when(F.length(c) > n, F.concat(F.regexp_replace(F.left(c, F.lit(n)), "\n", " "), F.lit("..."))).otherwise(F.regexp_replace(c, "\n", " "))


def terms(c: Column) -> Column:
    """Lower-cased words, in order."""
    return F.filter(F.split(F.lower(c), NOT_WORD), lambda w: w != "")


def bounded(text: Column, n: int = 10_000) -> Column:
    """The first n code points with a note that the rest is left out."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("\n\n... (truncated, use search_notes for specific sections)"))).otherwise(text)


def project_name(cwd: Column) -> Column:
    """The last part of a path, or unknown."""
    return F.coalesce(F.nullif(F.regexp_extract(F.rtrim(F.coalesce(cwd, F.lit("")), F.lit("/")), "[^/]+$", 0), F.lit("")), F.lit("unknown"))
