import json
from datetime import datetime, timezone

from lorekeep import schemas
from lorekeep.operators import fts, sessions, transcripts
from lorekeep.operators.store import Store

LINES = [
    {"type": "summary", "summary": "Draft"},
    {"type": "summary", "summary": "Seeds: an order"},
    {"type": "user", "message": {"role": "user", "content": "Which seeds are left?"}, "timestamp": "2025-11-20T08:15:00Z", "cwd": "/home/ida/garden"},
    {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "I count"}, "them", {"type": "tool_use", "name": "Shell", "input": {"command": "wc -l seeds.csv"}}, {"type": "tool_use", "name": "Odd", "input": {"z": 1, "a": ["é"]}}]}, "timestamp": "2025-11-20T08:16:30Z"},
    {"type": "tool_result", "content": "none"},
    {"type": "tool_result", "content": [{"type": "text", "text": "14 beans"}, {"type": "text", "text": "3 peas"}]},
    {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "ignored"}]}, "ts": 1763627100},
]
SID = "12345678-1234-1234-1234-123456789012"


def lines(spark, tmp_path, extra=()):
    d = tmp_path / "p"
    d.mkdir(exist_ok=True)
    rows = [json.dumps(x) for x in LINES]
    (d / f"{SID}.jsonl").write_text("\n".join([rows[0], "{broken", "", "[1, 2]", *rows[1:]]) + "\n")
    (d / "short.jsonl").write_text(rows[2])
    for name, text in extra:
        (d / name).write_text(text)
    return transcripts.read(spark, str(d))


def test_messages(spark, tmp_path):
    parsed = transcripts.parse(lines(spark, tmp_path).where(f"session_id = '{SID}'"))
    m = transcripts.with_tools(transcripts.messages(parsed)).orderBy("n").collect()
    assert [(x.role, x.text) for x in m] == [("user", "Which seeds are left?"), ("assistant", "I count\nthem"), ("user", "")]
    assert m[0].ts == datetime(2025, 11, 20, 8, 15) and m[2].ts == datetime(2025, 11, 20, 8, 25)
    assert [tuple(t) for t in m[1].tool_uses] == [("Shell", "wc -l seeds.csv", "14 beans 3 peas"), ("Odd", '{"a": ["\\u00e9"], "z": 1}', "")]
    assert transcripts.summaries(parsed).first().summary == "Seeds: an order" and transcripts.line_hashes(parsed).count() == 9
    assert transcripts.working_dirs(parsed).first().cwd == "/home/ida/garden"


def test_note(spark, tmp_path):
    ls = lines(spark, tmp_path)
    found = sessions.discover(ls)
    assert [tuple(r) for r in found.collect()] == [(SID, "/home/ida/garden")]
    r = sessions.notes_of(ls, found, "Sessions").first()
    assert r.rel_path == "Sessions/2025-11-20_12345678_garden.md" and r.n_messages == 3
    want = f"""---
session_id: {SID}
project: garden
cwd: /home/ida/garden
started: 2025-11-20T08:15:00+00:00
ended: 2025-11-20T08:25:00+00:00
tags: [claude-session, garden]
summary: "Seeds: an order"
---

# Session: Seeds: an order
**Date:** 2025-11-20 | **Duration:** 10m | **Project:** garden

## Summary
Seeds: an order

---

## Conversation

### User (08:15:00)
Which seeds are left?

### Assistant (08:16:30)
I count
them
> [!tool]- Shell: `wc -l seeds.csv`
> 14 beans 3 peas
> [!tool]- Odd: `{{"a": ["\\u00e9"], "z": 1}}`

### User (08:25:00)
"""
    assert r.body == want and r.section.startswith("\n---\n\n## Resumed (") and r.section.endswith("### User (08:25:00)\n")


def test_registry(spark):
    empty = spark.createDataFrame([], schemas.REGISTRY)
    new = spark.createDataFrame([("s1", "/A/Proj", "2026-01-01"), ("s2", "/b", "2026-01-02")], "session_id string, cwd string, started_at string")
    reg = sessions.register(empty, new)
    again = sessions.register(reg, new.selectExpr("session_id", "'/changed' AS cwd", "started_at"))
    assert {r.cwd for r in again.collect()} == {"/A/Proj", "/b"}
    done = sessions.end(again, spark.createDataFrame([("s1", "h1", "n.md"), ("nobody", "h", "p")], "session_id string, transcript_hash string, path string"))
    by = {r.session_id: r for r in done.collect()}
    assert len(by) == 2 and (by["s1"].status, by["s1"].last_transcript_hash, by["s2"].status) == ("completed", "h1", "active")
    cand = spark.createDataFrame([("s1", "h1"), ("s1", "h2"), ("s2", "")], "session_id string, transcript_hash string")
    assert sorted(tuple(r) for r in sessions.not_duplicates(cand, done).collect()) == [("s1", "h2"), ("s2", "")]
    assert [r.session_id for r in sessions.recent(done, 5).collect()] == ["s2", "s1"] and [r.session_id for r in sessions.recent(done, 5, "proj").collect()] == ["s1"]
    notes = spark.createDataFrame([("n.md", "x" * 10_001)], "source_file string, content string")
    assert sessions.session_note(done, notes, "s1").first().content.endswith("specific sections)") and sessions.session_note(done, notes, "s9").count() == 0


def test_backfill(spark, tmp_path):
    few = json.dumps({"type": "user", "message": {"content": "hi"}, "cwd": "/x/y"})
    other = "22345678-1234-1234-1234-123456789012"
    ls = lines(spark, tmp_path, [(f"{other}.jsonl", few)])
    empty = spark.createDataFrame([], schemas.REGISTRY)
    now = datetime(2026, 4, 1, tzinfo=timezone.utc)
    rows, reg = sessions.backfill(ls, empty, now=now)
    assert {r.session_id: r.outcome for r in rows.collect()} == {SID: "processed", other: "filtered"}
    assert {r.session_id: r.status for r in reg.collect()} == {SID: "completed", other: "active"}
    rows, _ = sessions.backfill(ls, spark.createDataFrame(reg.collect(), schemas.REGISTRY), now=now, min_messages=0)
    assert {r.session_id: r.outcome for r in rows.collect()} == {SID: "completed", other: "processed"}


def test_finalize_and_backfill(spark, tmp_path):
    """Notes, registry and index in one go; a second run appends what went on; a dry run writes nothing."""
    few = json.dumps({"type": "user", "message": {"content": "hi"}, "cwd": "/x/y"})
    other = "22345678-1234-1234-1234-123456789012"
    ls, s, root = lines(spark, tmp_path, [(f"{other}.jsonl", few)]), Store(spark, str(tmp_path / "st")), tmp_path / "notes"
    now = datetime(2026, 4, 1, tzinfo=timezone.utc)
    assert sessions.backfill_into(s, ls, str(root), dry_run=True, now=now) == (1, 1, 0) and not root.exists() and not s.exists("registry")
    assert sessions.backfill_into(s, ls, str(root), now=now) == (1, 1, 0)
    note = root / "2025-11-20_12345678_garden.md"
    assert "14 beans" in note.read_text() and {r.session_id: r.status for r in s.table("registry", schemas.REGISTRY).collect()} == {SID: "completed", other: "active"}
    t, before = s.table("notes", schemas.NOTES), note.read_text()
    assert t.where("project = 'garden'").count() > 1 and fts.stored(s.now(), "notes").corpus.first().n == t.count()
    assert sessions.backfill_into(s, ls, str(root), now=now) == (0, 2, 0)
    found = sessions.discover(ls).where(f"session_id = '{SID}'")
    assert sessions.finalize(s, ls, found, str(root), now=now) == 1
    assert note.read_text().startswith(before) and "## Resumed (2026-04-01" in note.read_text() and not list(root.glob(".lk-*"))
