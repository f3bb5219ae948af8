"""The verbs end to end over a small tree of logs."""

import json

import pytest
from pyspark.sql import functions as F

from threadmill.engine import Engine
from threadmill.operators import records as R
from threadmill.operators import segments

UUID = "7d1c35aa-92b4-4e0f-a6d3-5b8f0e21c794"


def log(path, *turns, cwd="/home/me/shop"):
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [{"type": "user" if i % 2 == 0 else "assistant", "cwd": cwd, "timestamp": f"2026-01-0{1 + i % 9}T00:00:00Z", "message": {"model": "m", "content": t if i % 2 == 0 else [{"type": "text", "text": t}]}} for i, t in enumerate(turns)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_verbs(spark, tmp_path):
    root = tmp_path / "logs"
    log(root / "p" / "aaa.jsonl", "set up docker", "done, see /h/private-notes/x.md")
    log(root / "p" / "abb.jsonl", "why is the cart slow", "an index is missing", cwd="/home/me/cart")
    log(root / "p" / "secret.jsonl", "hush", "yes", cwd="/home/me/private-notes/q")
    e = Engine(spark, str(tmp_path / "store"), [("claude", [str(root)]), ("codex", [])], ["**/private-notes/**"])
    c = e.ingest("2026-02-01")
    assert (c["new"], c["excluded"], c["total"]) == (2, 1, 3)
    assert {r["sid"] for r in e.sessions().collect()} == {"claude/aaa", "claude/abb"} and e.sessions().where(F.contains("excerpt", F.lit("private-notes"))).count() == 0
    assert e.sessions().where(F.size(R.problems()) > 0).count() == 0
    assert [r["sid"] for r in e.search(["docker"], "2026-02-01").collect()] == ["claude/aaa"] and e.search([], "2026-02-01", cwd="CART").count() == 1
    assert "claude/aaa" in e.lines(e.search(["docker"], "2026-02-01")).first()["line"] and json.loads(e.lines(e.search(["docker"], "2026-02-01"), "ndjson").first()["line"])["sid"] == "claude/aaa"
    assert e.resume("claude/ab") == "cd /home/me/cart && claude --resume abb" and "transcript tail" in e.show("claude/aaa")
    with pytest.raises(LookupError):
        e.resume("claude/a")
    assert e.ingest("2026-02-02")["kept"] == 2  # nothing has changed

    assert e.backfill(lambda text, previous: f"@@S1@@\n- **Asked:** {len(text) > 0}\n- **Resolved:** done") == 2
    assert e.backfill(lambda text, previous: "") == 0 and {r["summary_state"] for r in e.sessions().collect()} == {"done"} and e.sessions().first()["summary"]["asked"] == "True"
    log(root / "p" / "aaa.jsonl", "set up docker", "done", "more", "yes", "and more", "fine")
    assert e.ingest("2026-02-03", event="stop")["changed"] == 1
    r = {x["sid"]: x for x in e.sessions().collect()}["claude/aaa"]
    assert [(s["start"], s["end"], s["event"], s["state"]) for s in r["segments"]] == [(0, 6, "stop", "pending")] and r["summary_state"] == "pending" and r["summary"]["asked"] == "True"
    assert e.backfill(lambda text, previous: "no labels") == 1 and {x["summary_state"] for x in e.sessions().where("sid = 'claude/aaa'").collect()} == {"error"}

    legacy = spark.createDataFrame([("claude", "old1", "- **Asked:** x\n- **Done:** y", "2025-01-01"), ("codex", f"rollout-2025-{UUID}", "_", "2025-01-01"), ("claude", "aaa", "- **Asked:** z", "2025-01-01"), ("odd", "q", "", "")], "source string, session_id string, summary string, date string")
    assert {r["session_id"]: r["action"] for r in e.convert(legacy).collect()} == {"old1": "append", f"rollout-2025-{UUID}": "append", "aaa": "merge", "q": "unknown"}
    got = {r["sid"]: r for r in e.sessions().collect()}
    assert got["claude/old1"]["summary"]["completed"] == "y" and got["claude/aaa"]["summary"]["asked"] == "z" and got[f"codex/{UUID}"]["summary_state"] == "pending"
    assert {(r["harness"], r["sessions"]) for r in e.status().collect()} == {(None, 4), ("claude", 3), ("codex", 1)}

    assert e.forget("/home/me/cart*", dry_run=True) == ["claude/abb"] and e.forget("/home/me/cart*") == ["claude/abb"] and e.forget("codex/") == [f"codex/{UUID}"]
    log(root / "p" / "abb.jsonl", "why", "x", "y", cwd="/home/me/cart")
    e.ingest("2026-02-04")
    assert {r["sid"] for r in e.sessions().collect()} == {"claude/aaa", "claude/old1"}

    spool = tmp_path / "spool"
    spool.mkdir()
    log(root / "p" / "new.jsonl", "hello", "hi")
    (spool / "1.json").write_text(json.dumps({"session_id": "new", "transcript_path": "/p/new.jsonl", "hook_event_name": "SessionEnd"}))
    e.capture(str(spool), str(tmp_path / "cp"), "2026-02-05").awaitTermination(200)
    assert [s["event"] for s in {r["sid"]: r for r in e.sessions().collect()}["claude/new"]["segments"]] == ["session_end"]


def test_problems_and_old_files(spark):
    d = R.conform(spark.createDataFrame([("x", "odd", "", "maybe")], "sid string, harness string, date string, resolved string"))
    assert [p["field"] for p in d.select(R.problems()).first()[0]] == ["date", "harness", "resolved", "sid"]
    good = R.conform(spark.createDataFrame([("claude/x", "claude", "2026-01-01", "open", [(1, "stop", None, 5, 3, 9, "t", "odd", None)])], f"sid string, harness string, date string, resolved string, segments array<{segments.SEGMENT}>"))
    assert [tuple(p) for p in good.select(R.problems()).first()[0]] == [("segments[0].state", "one of pending, done, error"), ("segments[0].end", "not before start")]
    t = spark.createDataFrame([("h: 1\n---\n\nbody",), ("no header",), (None,)], "x string").select(R.sidecar_body(F.col("x"))).collect()
    assert [r[0] for r in t] == ["body", "no header", ""]
    w = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, mtime int, size int")
    assert sorted(map(tuple, R.upgrade_watermarks(w, F.col("k")).collect())) == [("a", 2, 20), ("b", 1, 5)]
    assert R.roots("/nowhere/at/all") == [] and R.roots("/tmp", False) == []
