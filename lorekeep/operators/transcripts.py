"""Chat transcripts, JSON lines of many shapes, to messages with tool uses."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import content_hash, strip, truncate

TOOL = "array<struct<tool_name:string,input_summary:string,output_summary:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """session_id, path, pos, line of every line of *.jsonl files; the file's stem is the session."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("session_id"), "value")
    return files.select("session_id", "path", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "line"))


def parse(lines: DataFrame) -> DataFrame:
    """session_id, pos, hash, v: lines that aren't blank; v is null where a line isn't a JSON object."""
    kept = lines.withColumn("line", strip(F.col("line"))).where("line <> ''")
    v = F.try_parse_json("line")
    rows = kept.withColumn("v", v).withColumn("hash", content_hash(F.col("line")))
    return rows.withColumn("v", F.when(F.schema_of_variant("v").like("OBJECT%"), F.col("v")))


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _text(blocks: Column, plain: Column, sep: str = "\n") -> Column:
    """A string as it is; of a list its strings and the texts of its text blocks, in order."""
    piece = lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")).when(F.try_variant_get(b, "$.type", "string") == "text", F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
    return F.when(blocks.isNotNull(), F.array_join(F.filter(F.transform(blocks, piece), lambda x: x.isNotNull()), sep)).otherwise(F.coalesce(plain, F.lit("")))


@F.pandas_udf(T.StringType())
def _dumps(text: pd.Series) -> pd.Series:
    """JSON in Python's spacing, with escapes for other characters than ASCII."""
    return text.map(lambda s: None if s is None else json.dumps(json.loads(s)))


def timestamp(*fields: Column) -> Column:
    """The first that parses: a number of seconds since 1970, or ISO text; in UTC."""
    one = lambda v: F.when(v.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"), F.timestamp_seconds(v.try_cast("double"))).otherwise(v.try_cast("timestamp"))
    return F.coalesce(*(one(f) for f in fields))


def messages(parsed: DataFrame) -> DataFrame:
    """session_id, pos, n, role, text, ts, tool_uses of user and assistant lines, n from 0 in order of lines.

    A line of type tool_result sets the output of the first tool of the message before it; the last such line counts.
    """
    rows = parsed.where("v is not null").select("session_id", "pos", "v", _get("v", "$.type").alias("type"))
    content, plain = _get("v", "$.message.content", "array<variant>"), _get("v", "$.message.content")
    result_blocks, result_plain = _get("v", "$.content", "array<variant>"), _get("v", "$.content")
    is_message = F.col("type").isin("user", "assistant")
    rows = rows.where(is_message | (F.col("type") == "tool_result"))
    order = Window.partitionBy("session_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.max(F.when(is_message, F.col("pos"))).over(order))
    result = truncate(_text(result_blocks, result_plain, " "), 300)
    outputs = rows.where("type = 'tool_result' and at is not null").groupBy("session_id", "at").agg(F.max_by(result, "pos").alias("output"))
    # what an input is summed up by: a command, a path, a query, else the whole as JSON
    inp = lambda b, k: F.try_variant_get(b, f"$.input.{k}", "string")
    known = lambda b: F.coalesce(truncate(F.nullif(inp(b, "command"), F.lit(""))), F.nullif(inp(b, "file_path"), F.lit("")), truncate(F.nullif(inp(b, "query"), F.lit(""))))
    uses = F.filter(content, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    made = F.transform(uses, lambda b: F.struct(F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("unknown")).alias("tool_name"), known(b).alias("input_summary"), F.to_json(F.try_variant_get(b, "$.input", "variant")).alias("whole")))
    base = rows.where(is_message).select("session_id", "pos", "type", F.coalesce(_get("v", "$.message.role"), F.col("type")).alias("role"), _text(content, plain).alias("text"), timestamp(*(_get("v", f"$.{k}") for k in ("timestamp", "ts", "created_at"))).alias("ts"), F.coalesce(made, F.array()).alias("made"))
    base = base.join(outputs.withColumnRenamed("at", "pos"), ["session_id", "pos"], "left")
    return base.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("pos")) - 1)


def with_tools(msgs: DataFrame) -> DataFrame:
    """messages() with tool_uses; inputs without a known field are given as JSON, in the few messages that have such."""
    whole = msgs.select("session_id", "n", F.posexplode("made").alias("k", "m")).where("m.input_summary is null").select("session_id", "n", "k", truncate(F.coalesce(_dumps("m.whole"), F.lit("{}"))).alias("s"))
    found = whole.groupBy("session_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("lk_s"))
    rows = msgs.join(found, ["session_id", "n"], "left")
    use = lambda m, k: F.struct(m["tool_name"].alias("tool_name"), F.coalesce(m["input_summary"], F.try_element_at("lk_s", k), F.lit("")).alias("input_summary"), F.when(k == 0, F.coalesce("output", F.lit(""))).otherwise(F.lit("")).alias("output_summary"))
    return rows.select("session_id", "pos", "n", "role", "text", "ts", F.transform("made", use).alias("tool_uses"))


def summaries(parsed: DataFrame) -> DataFrame:
    """session_id, summary: of each session the last summary line's."""
    rows = parsed.where(_get("v", "$.type") == "summary")
    return rows.groupBy("session_id").agg(F.max_by(F.coalesce(_get("v", "$.summary"), F.lit("")), "pos").alias("summary"))


def line_hashes(parsed: DataFrame) -> DataFrame:
    return parsed.select("session_id", "hash").distinct()


def working_dirs(parsed: DataFrame) -> DataFrame:
    """session_id, cwd: of each session the first that isn't empty."""
    rows = parsed.select("session_id", "pos", _get("v", "$.cwd").alias("cwd")).where("cwd <> ''")
    return rows.groupBy("session_id").agg(F.min_by("cwd", "pos").alias("cwd"))


def session_spans(msgs: DataFrame, now: datetime | None = None) -> DataFrame:
    """session_id, started_at, ended_at: times of the first and the last message, or now where they have none."""
    now = now or datetime.now(timezone.utc)
    return msgs.groupBy("session_id").agg(F.coalesce(F.min_by("ts", "n"), F.lit(now)).alias("started_at"), F.coalesce(F.max_by("ts", "n"), F.lit(now)).alias("ended_at"), F.count("*").alias("n_messages"))
