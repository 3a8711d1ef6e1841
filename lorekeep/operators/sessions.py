"""The session registry, and from transcripts to notes for all pending sessions at once."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import schemas
from lorekeep.functions.text import bounded, content_hash
from lorekeep.operators import incremental, markdown, transcripts
from lorekeep.operators.store import Changes, Snapshot, Store, insert_absent
from lorekeep.sources import files


def register(registry: DataFrame, sessions: DataFrame) -> DataFrame:
    """With active entries for sessions (session_id, cwd, started_at as text) that it lacks; existing ones are untouched."""
    new = sessions.select("session_id", "cwd", "started_at", F.lit("").alias("last_transcript_hash"), F.lit("").alias("markdown_path"), F.lit("active").alias("status"))
    return insert_absent(registry, new.dropDuplicates(["session_id"]), ["session_id"])


def end(registry: DataFrame, ended: DataFrame) -> DataFrame:
    """Completed with hash and path where ended (session_id, transcript_hash, path) has an entry; unknown sessions change nothing."""
    new = ended.select("session_id", F.col("transcript_hash").alias("lk_h"), F.col("path").alias("lk_p"), F.lit(True).alias("lk_e")).dropDuplicates(["session_id"])
    rows = registry.join(new, "session_id", "left")
    return rows.select("session_id", "cwd", "started_at", F.coalesce("lk_h", "last_transcript_hash").alias("last_transcript_hash"), F.coalesce("lk_p", "markdown_path").alias("markdown_path"), F.when(F.col("lk_e"), "completed").otherwise(F.col("status")).alias("status"))


def not_duplicates(sessions: DataFrame, registry: DataFrame) -> DataFrame:
    """sessions (session_id, transcript_hash) without those whose stored hash is the same and not empty."""
    seen = registry.where("last_transcript_hash <> ''").select("session_id", F.col("last_transcript_hash").alias("transcript_hash"))
    return sessions.join(seen, ["session_id", "transcript_hash"], "left_anti")


def not_completed(sessions: DataFrame, registry: DataFrame, force: bool = False) -> DataFrame:
    return sessions if force else sessions.join(registry.where("status = 'completed'").select("session_id"), "session_id", "left_anti")


def long_enough(spans: DataFrame, least: int) -> DataFrame:
    """Sessions of at least so many messages; spans: with n_messages. None or less keeps all."""
    return spans.where(F.col("n_messages") >= least) if least and least > 0 else spans


def recent(registry: DataFrame, limit: int = 10, project: str | None = None) -> DataFrame:
    """The latest entries by started_at as text; project: within cwd, whatever its case."""
    rows = registry.where(F.lower("cwd").contains(project.lower())) if project else registry
    return rows.orderBy(F.coalesce("started_at", F.lit("")).desc(), "session_id").limit(limit)


def session_note(registry: DataFrame, notes: DataFrame, session_id: str, most: int = 10_000) -> DataFrame:
    """content of a session's note, cut at so many characters; notes: source_file, content."""
    own = registry.where(F.col("session_id") == session_id).select(F.col("markdown_path").alias("source_file"))
    return notes.join(F.broadcast(own.limit(1)), "source_file").select(bounded(F.col("content"), most).alias("content"))


def discover(lines: DataFrame) -> DataFrame:
    """session_id, cwd of transcripts named by an id of 36 characters with 4 dashes that have a working directory."""
    rows = lines.where((F.length("session_id") == 36) & (F.length(F.regexp_replace("session_id", "[^-]", "")) == 4))
    return transcripts.working_dirs(transcripts.parse(rows))


def notes_of(lines: DataFrame, sessions: DataFrame, folder: str = "", now: datetime | None = None) -> DataFrame:
    """session_id, rel_path, body, section, n_messages, transcript_hash for sessions (session_id, cwd), all in one plan.

    section is what to append to an existing note of a session that went on.
    """
    now = now or datetime.now(timezone.utc)
    own = lines.join(sessions.select("session_id"), "session_id", "left_semi")
    parsed = transcripts.parse(own)
    msgs = transcripts.with_tools(transcripts.messages(parsed))
    whole = own.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("whole")).select("session_id", content_hash(F.col("whole")).alias("transcript_hash"))
    joined = sessions.join(transcripts.session_spans(msgs, now), "session_id", "left").join(markdown.conversations(msgs), "session_id", "left").join(transcripts.summaries(parsed), "session_id", "left").join(whole, "session_id", "left")
    joined = joined.withColumns({"started_at": F.coalesce("started_at", F.lit(now)), "ended_at": F.coalesce("ended_at", F.lit(now)), "n_messages": F.coalesce("n_messages", F.lit(0))})
    docs = markdown.document(joined)
    return docs.select("session_id", "cwd", markdown.note_path(docs, folder).alias("rel_path"), "body", markdown.resumed(F.col("conversation"), F.lit(now)).alias("section"), "n_messages", "transcript_hash", markdown.iso(F.col("started_at")).alias("started_at"))


def backfill(lines: DataFrame, registry: DataFrame, *, force: bool = False, min_messages: int = 3, folder: str = "", now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, registry): outcome processed, filtered, completed or duplicate of each discovered session, with its note; filtered ones stay registered as active."""
    found = discover(lines)
    made = notes_of(lines, found, folder, now)
    done = registry.select("session_id", F.col("status").alias("lk_s"), F.col("last_transcript_hash").alias("lk_h"))
    rows = made.join(done, "session_id", "left")
    outcome = (
        F.when(F.lit(not force) & F.coalesce(F.col("lk_s") == "completed", F.lit(False)), "completed")
        .when(F.lit(not force) & F.coalesce((F.col("lk_h") == F.col("transcript_hash")) & (F.col("lk_h") != ""), F.lit(False)), "duplicate")
        .when(F.col("n_messages") < min_messages, "filtered").otherwise("processed")
    )
    rows = rows.withColumn("outcome", outcome).drop("lk_s", "lk_h")
    fresh = register(registry, rows.where("outcome <> 'completed'"))
    return rows, end(fresh, rows.where("outcome = 'processed'").select("session_id", "transcript_hash", F.col("rel_path").alias("path"))).select(*schemas.REGISTRY.names)


class Outcomes(NamedTuple):
    processed: int
    skipped: int
    failed: int


def finalize(store: Store, lines: DataFrame, sessions: DataFrame, root: str, folder: str = "", now: datetime | None = None, auto_index: bool = True) -> int:
    """Writes the notes of sessions (session_id, cwd) below root, a section to the note of one that has a note, then the registry, and indexes the notes; how many sessions.

    The notes come first and the registry in one commit after them, so a run that breaks off is made good by the next.
    """
    spark, now = store.spark, now or datetime.now(timezone.utc)
    made = store.scratch(notes_of(lines, sessions, folder, now), "finalized")
    registry = store.table("registry", schemas.REGISTRY)
    rows = made.join(registry.where("markdown_path <> ''").select("session_id", "markdown_path"), "session_id", "left")
    rows = store.scratch(rows, "finalized")
    files.write_notes(rows.where("markdown_path is null").select("rel_path", "body"), root)
    files.write_notes(rows.where("markdown_path is not null").select(F.col("markdown_path").alias("rel_path"), F.col("section").alias("body")), root, append=True)
    ended = rows.select("session_id", "transcript_hash", F.coalesce("markdown_path", "rel_path").alias("path"))

    def make(at: Snapshot) -> Changes:
        fresh = register(at.table("registry", schemas.REGISTRY), rows)
        return Changes(replace={"registry": end(fresh, ended).select(*schemas.REGISTRY.names)})

    store.transact(make)
    if auto_index:
        incremental.index_notes(store, files.vault(spark, [root]))
    return rows.count()


def backfill_into(store: Store, lines: DataFrame, root: str, *, dry_run: bool = False, force: bool = False, min_messages: int = 3, folder: str = "", now: datetime | None = None) -> Outcomes:
    """backfill() and finalize() of what it finds; a dry run counts alone. Filtered sessions are registered as active; all sessions fail together or none."""
    now = now or datetime.now(timezone.utc)
    outcomes = store.scratch(backfill(lines, store.table("registry", schemas.REGISTRY), force=force, min_messages=min_messages, folder=folder, now=now)[0].select("session_id", "cwd", "started_at", "outcome"), "outcomes")
    n = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    done = Outcomes(n.get("processed", 0), sum(v for k, v in n.items() if k != "processed"), 0)
    if dry_run:
        return done
    store.transact(lambda at: Changes(replace={"registry": register(at.table("registry", schemas.REGISTRY), outcomes.where("outcome <> 'completed'"))}))
    try:
        if done.processed:
            finalize(store, lines, outcomes.where("outcome = 'processed'").select("session_id", "cwd"), root, folder, now)
    except Exception:  # as for a single session, what fails is counted
        return Outcomes(0, done.skipped, done.processed)
    return done
