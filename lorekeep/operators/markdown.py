"""Markdown: front matter, chunks by heading, and transcripts as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import project_name, strip

MARK = "\x00"
#: Fixed value: the tag of notes made of sessions.
SESSION_TAG = "claude-session"


def front_matter(text: Column) -> Column:
    """Struct of session_id, project, tags, raw (map) and body. Without a closing line the whole text is the body."""
    end = F.locate("\n---", text, 4)
    has = text.startswith("---") & (end > 0)
    head, rest = F.substring(text, F.lit(4), end - 4), F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"\A\n+", "")
    value = lambda s: F.btrim(F.btrim(strip(s), F.lit('"')), F.lit("'"))
    pairs = F.filter(F.split(head, "\n"), lambda line: line.contains(":"))
    entry = lambda line: F.struct(strip(F.substring_index(line, ":", 1)).alias("key"), value(F.substring(line, F.locate(":", line) + 1, F.length(line))).alias("value"))
    entries = F.transform(pairs, entry)
    # the last of equal keys counts, whatever the session's policy on them
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    raw = F.when(has, F.map_from_entries(last)).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    get = lambda k: F.coalesce(F.try_element_at(raw, F.lit(k)), F.lit(""))
    tags = F.filter(F.transform(F.split(F.btrim(get("tags"), F.lit("[]")), ","), lambda t: F.btrim(strip(t), F.lit("#"))), lambda t: t != "")
    tags = F.transform(tags, strip)
    return F.struct(get("session_id").alias("session_id"), get("project").alias("project"), tags.alias("tags"), raw.alias("raw"), F.when(has, rest).otherwise(text).alias("body"))


def heading_chunks(body: Column) -> Column:
    """Array of (heading, text): split before headings of the second and third level; text before the first is (preamble), a text without headings one chunk with none. Blank chunks are left out."""
    heading = r"(?mdU)^(#{2,3})\s+(.+)$"
    parts = F.split(F.regexp_replace(body, heading, MARK + "$0"), MARK)
    first = F.struct(F.when(F.size(parts) == 1, "").otherwise("(preamble)").alias("heading"), F.get(parts, F.lit(0)).alias("text"))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(strip(F.regexp_extract(p, heading, 2)).alias("heading"), p.alias("text")))
    every = F.concat(F.array(first), rest)
    return F.filter(F.transform(every, lambda c: F.struct(c["heading"].alias("heading"), strip(c["text"]).alias("text"))), lambda c: c["text"] != "")


def chunk_notes(notes: DataFrame) -> DataFrame:
    """Rows of the notes table without vectors from (source_file, content, content_hash): narrow, no shuffle."""
    rows = notes.withColumn("fm", front_matter(F.col("content"))).select("source_file", "content_hash", "fm", F.posexplode(heading_chunks(F.col("fm.body"))).alias("chunk_index", "c"))
    return rows.select(
        F.concat_ws("_", "content_hash", "chunk_index").alias("id"), "source_file", "c.heading", "c.text", "content_hash", "fm.session_id", "fm.project", F.array_join("fm.tags", ",").alias("tags"), F.col("chunk_index").cast("int").alias("chunk_index")
    )


def yaml(c: Column) -> Column:
    """Quoted, with escapes, if it has characters that YAML reads."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(c.rlike("[:{}'\"\\[\\]&*!|>%@`]"), quoted).otherwise(c)


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only if there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(ts, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(ts, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def duration(start: Column, end: Column) -> Column:
    minutes = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60_000_000)
    long = F.concat((F.floor(minutes / 60)).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m"))
    return F.when(start.isNull() | end.isNull(), "unknown").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(long)


def message(role: Column, text: Column, ts: Column | None = None, tools: Column | None = None) -> Column:
    """A message as a section; every role but user is the assistant's."""
    clock = F.lit("") if ts is None else F.coalesce(F.concat(F.lit(" ("), F.date_format(ts, "HH:mm:ss"), F.lit(")")), F.lit(""))
    head = F.concat(F.lit("### "), F.when(role == "user", "User").otherwise("Assistant"), clock)
    body = F.nullif(strip(text), F.lit(""))
    if tools is None:
        return F.concat_ws("\n", head, body)
    output = lambda t: F.when(t["output_summary"] != "", F.array_join(F.transform(F.split(t["output_summary"], "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"))
    one = lambda t: F.concat_ws("\n", F.concat(F.lit("> [!tool]- "), t["tool_name"], F.lit(": `"), t["input_summary"], F.lit("`")), output(t))
    return F.concat_ws("\n", head, body, F.nullif(F.array_join(F.transform(tools, one), "\n"), F.lit("")))


def conversations(msgs: DataFrame, key: str = "session_id", order: str = "n", section: Column | None = None) -> DataFrame:
    """key, conversation: a session's sections in order, each followed by an empty line."""
    s = message(F.col("role"), F.col("text"), F.col("ts"), F.col("tool_uses")) if section is None else section
    return msgs.select(key, F.struct(F.col(order).alias("o"), s.alias("s")).alias("x")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(x["s"], F.lit("\n"))), "\n").alias("conversation"))


def document(sessions: DataFrame) -> DataFrame:
    """sessions with body: the whole note of (session_id, cwd, started_at, ended_at, summary, conversation)."""
    project, summary = project_name(F.col("cwd")), F.nullif(F.col("summary"), F.lit(""))
    fm = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("session_id: "), "session_id"), F.concat(F.lit("project: "), project), F.concat(F.lit("cwd: "), yaml(F.col("cwd"))), F.concat(F.lit("started: "), iso(F.col("started_at"))),
        F.concat(F.lit("ended: "), iso(F.col("ended_at"))), F.concat(F.lit(f"tags: [{SESSION_TAG}, "), project, F.lit("]")), F.concat(F.lit("summary: "), yaml(summary)), F.lit("---"),
    )
    title = F.coalesce(summary, F.concat(F.lit("Session "), "session_id"))
    title = F.when(F.length(title) > 80, F.concat(F.left(title, F.lit(77)), F.lit("..."))).otherwise(title)
    line = F.concat(F.lit("**Date:** "), F.coalesce(F.date_format("started_at", "yyyy-MM-dd"), F.lit("unknown")), F.lit(" | **Duration:** "), duration(F.col("started_at"), F.col("ended_at")), F.lit(" | **Project:** "), project)
    about = F.concat(F.lit("## Summary\n"), summary, F.lit("\n"))
    talk = F.concat(F.lit("---\n\n## Conversation\n"), F.coalesce(F.concat(F.lit("\n"), "conversation"), F.lit("")))
    return sessions.withColumn("body", F.concat_ws("\n", F.concat(fm, F.lit("\n")), F.concat(F.lit("# Session: "), title), F.concat(line, F.lit("\n")), about, talk))


def resumed(conversation: Column, at: Column) -> Column:
    """A section for a session that went on, to append to its note."""
    return F.concat(F.lit("\n---\n\n## Resumed ("), F.coalesce(iso(at), F.lit("unknown")), F.lit(")\n"), F.coalesce(F.concat(F.lit("\n"), conversation), F.lit("")))


def note_path(sessions: DataFrame, folder: str = "") -> Column:
    """<folder>/<date>_<first 8 of the session>_<project>.md"""
    name = F.regexp_replace(project_name(F.col("cwd")), "[ /]", "-")
    return F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), F.date_format("started_at", "yyyy-MM-dd"), F.lit("_"), F.left("session_id", F.lit(8)), F.lit("_"), name, F.lit(".md"))
