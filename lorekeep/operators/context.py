"""Parts of files with the lines around them, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import preview

#: What ends a line, as Python's splitlines.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def code_context(files: DataFrame, start: int, end: int | None = None, around: int = 10) -> DataFrame:
    """source_file, line_no, marked, shown: lines start to end, marked, of each file (source_file, content), and so many around them."""
    end = start if end is None else end
    content = F.regexp_replace("content", f"(?:{LINE_ENDS})\\z", "")
    lines = files.select("source_file", F.posexplode(F.split(content, LINE_ENDS)).alias("i", "line"))
    rows = lines.where((F.col("i") >= max(0, start - 1 - around)) & (F.col("i") < end + around))
    marked = (F.col("i") >= start - 1) & (F.col("i") < end)
    shown = F.concat(F.when(marked, "→ ").otherwise("  "), F.format_string("%4d", F.col("i") + 1), F.lit(" | "), "line")
    return rows.select("source_file", (F.col("i") + 1).alias("line_no"), marked.alias("marked"), shown.alias("shown"))


def as_json(results: DataFrame) -> DataFrame:
    """One JSON object a row, without the vector."""
    rows = results.drop("vector")
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def previews(results: DataFrame, n: int = 200) -> DataFrame:
    return results.withColumn("preview", preview(F.col("text"), n))
