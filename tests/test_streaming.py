import json

from lorekeep.operators import transcripts
from lorekeep.streaming import ledger


def test_windows_and_late_rows(spark, tmp_path):
    src, ck = tmp_path / "in", tmp_path / "ck"
    src.mkdir()
    rows = [("2026-01-01T00:10:00Z", 5), ("2026-01-01T00:50:00Z", 7), ("2026-01-01T01:10:00Z", 1), ("2026-01-02T00:00:00Z", 1)]
    (src / "a.json").write_text("\n".join(json.dumps({"ts": t, "model": "m", "tokens": n, "cost": 0.5}) for t, n in rows) + "\nbroken\n")
    df = ledger.windowed_cost(ledger.stream(spark, str(src)), "1 hour")
    run = lambda: df.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(ck)).trigger(availableNow=True).start().awaitTermination()
    run()
    (src / "b.json").write_text(json.dumps({"ts": "2026-01-01T00:20:00Z", "model": "m", "tokens": 99, "cost": 1}) + "\n")  # later than the watermark
    run()
    got = sorted((str(r.start), r.tokens, r.entries) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2026-01-01 00:00:00", 12, 2), ("2026-01-01 01:00:00", 1, 1)]


def test_transcripts_once(spark, tmp_path):
    src, seen = tmp_path / "t", []
    src.mkdir()
    line = json.dumps({"type": "user", "message": {"content": "hi"}})
    (src / "s1.jsonl").write_text(line + "\n" + line)
    commit = lambda df, n: seen.extend(r.session_id for r in transcripts.messages(transcripts.parse(df)).collect())
    for _ in range(2):
        ledger.into_notes(spark, str(src), str(tmp_path / "ck"), commit).awaitTermination()
    assert seen == ["s1", "s1"]
