"""The store under stops and rivals, incremental ingest, and the stored index."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from threadmill.engine import Engine
from threadmill.functions import text as T
from threadmill.operators import fold, index, store
from threadmill.sources import logs
from threadmill.streaming import capture


def log(path, *turns, cwd="/home/me/shop"):
    path.parent.mkdir(parents=True, exist_ok=True)
    rows = [{"type": "user" if i % 2 == 0 else "assistant", "cwd": cwd, "timestamp": "2026-01-01T00:00:00Z", "message": {"model": "m", "content": t if i % 2 == 0 else [{"type": "text", "text": t}]}} for i, t in enumerate(turns)]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_a_stopped_writer_changes_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "logs"
    for i in range(3):
        log(root / "p" / f"s{i}.jsonl", f"question {i}", "answer")
    e = Engine(spark, str(tmp_path / "store"), [("claude", [str(root)])])
    assert e.ingest("2026-01-02")["new"] == 3
    log(root / "p" / "s9.jsonl", "new", "answer")
    with monkeypatch.context() as m:
        m.setattr(store.Store, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            e.ingest("2026-01-03")
    assert e.sessions().count() == 3 and e.store.manifest()[0] == 1
    assert e.ingest("2026-01-03")["new"] == 1 and e.sessions().count() == 4  # watermarks had not moved on alone
    (tmp_path / "store" / ".torn.manifest").write_text("{")
    assert e.store.manifest()[0] == 2


def test_of_two_writers_none_loses_rows(spark, tmp_path):
    at = store.Store(spark, str(tmp_path / "s"))
    row = lambda *x: spark.createDataFrame([(v,) for v in x], "sid string")
    at.write("sessions", row("a"))
    number, tables = at.manifest()
    at.commit(number, tables | {"sessions": at.put("sessions", row("b"))})
    with pytest.raises(store.Conflict):
        at.commit(number, tables | {"sessions": at.put("sessions", row("c"))})
    add = lambda x: at.change(lambda t: {"sessions": at.read("sessions", t).unionByName(row(x))})
    rivals = [threading.Thread(target=add, args=(x,)) for x in "xyz"]
    for r in rivals:
        r.start()
    for r in rivals:
        r.join()
    assert sorted(r["sid"] for r in at.read("sessions").collect()) == ["b", "x", "y", "z"]
    for i in range(7):
        at.write("sessions", row(str(i)))
    assert len([n for n in os.listdir(tmp_path / "s") if n.startswith("manifest")]) == store.KEPT


def test_only_changed_files_are_read(spark, tmp_path, monkeypatch):
    root, read = tmp_path / "logs", []
    for i in range(200):
        log(root / f"p{i % 7}" / f"s{i}.jsonl", f"question {i}", "answer")
    plain = logs.extract_files
    monkeypatch.setattr(logs, "extract_files", lambda s, paths, kind: read.append(len(paths)) or plain(s, paths, kind))
    e = Engine(spark, str(tmp_path / "store"), [("claude", [str(root)])], ["**/private-notes/**"])
    assert e.ingest("2026-01-02")["new"] == 200 and e.ingest("2026-01-03")["kept"] == 200
    log(root / "p1" / "s1.jsonl", "question 1", "answer", "see /h/private-notes/x.md and /h/later/y.md", "yes")
    c = e.ingest("2026-01-04")
    assert read == [200, 1] and (c["changed"], c["kept"]) == (1, 199)
    got = e.sessions().where("sid = 'claude/s1'").first()
    assert "[excluded-path] and /h/later/y.md" in got["excerpt"]
    e.exclude = ["**/later/**", "**/private-notes/**"]  # stored records are scrubbed when the globs change
    e.ingest("2026-01-05")
    assert "/later/" not in str(e.sessions().where("sid = 'claude/s1'").first()) and read == [200, 1]
    # a session found twice, as while it moves to an archive, counts once, as its later file says; a cut-off line is a warning
    log(root / "archive" / "s2.jsonl", "question 2", "answer", "more", "done")
    os.utime(root / "archive" / "s2.jsonl", (2e9, 2e9))
    with open(root / "p3" / "s3.jsonl", "a") as f:
        f.write('{"type": "us')
    assert e.ingest("2026-01-06")["total"] == 200
    rows = {r["sid"]: r for r in e.sessions().where("sid in ('claude/s2', 'claude/s3')").collect()}
    assert rows["claude/s2"]["turn_count"] == 4 and rows["claude/s3"]["parse_warnings"] == 1


def test_the_index_follows_the_store(spark, tmp_path):
    root = tmp_path / "logs"
    log(root / "p" / "a.jsonl", "why does git push hang", "the résumé was large")
    log(root / "p" / "b.jsonl", "push the button, then git", "fixed")
    e = Engine(spark, str(tmp_path / "store"), [("claude", [str(root)])])
    assert e.search(["x"], "2026-02-01").count() == 0
    e.ingest("2026-01-02")
    legacy = [("claude", "c", "- **Asked:** run git push again\n- **Done:** Résumé fixed", "2025-01-01")]
    e.convert(spark.createDataFrame(legacy, "source string, session_id string, summary string, date string"))
    find = lambda *t: sorted(r["sid"] for r in e.search(list(t), "2026-02-01").collect())
    assert find("git push") == ["claude/c"] and find("RÉSUMÉ") == ["claude/c"] and find("fixes") == ["claude/c"] and find("push git") == []
    assert not index.sync(e.store)
    first = [t for t in e.store.manifest()[1] if t.startswith("index1_p-")]
    e.backfill(lambda text, previous: "- **Asked:** about git push\n- **Resolved:** done")
    assert find("git push") == ["claude/a", "claude/b", "claude/c"] and len([t for t in e.store.manifest()[1] if t.startswith("index1_p-")]) == len(first) + 1
    assert e.forget("claude/b") == ["claude/b"] and find("git push") == ["claude/a", "claude/c"]
    # an index of another schema is dropped
    e.store.change(lambda t: {k: None for k in t if k.startswith("index1")} | {"index0_docs": "index0_docs-x"})
    assert find("git push") == ["claude/a", "claude/c"] and "index0_docs" not in e.store.manifest()[1]
    assert e.search(["git push"], "2026-02-01", engine="linear").count() == 2


def test_segments_of_the_index_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENTS", 2)
    from threadmill.operators import records as R

    at = store.Store(spark, str(tmp_path / "s"))
    for i in range(4):
        rows = [(f"claude/{k}", f"w{k} round{i if k == 0 else 0}", str(i if k == 0 else 0)) for k in range(i + 1)]
        at.write("sessions", R.conform(spark.createDataFrame(rows, "sid string, cwd string, indexed_at string")))
        assert index.sync(at)
        assert len(index.segment_tables(at.manifest()[1])) <= 2
        found = {r["term"]: r["sid"] for r in index.postings(at, at.manifest()[1]).where("term like 'round%'").collect()}
        assert (found.get(f"round{i}") == "claude/0") and len({r["sid"] for r in index.postings(at, at.manifest()[1]).collect()}) == i + 1


def test_backfill_in_steps(spark, tmp_path):
    root = tmp_path / "logs"
    for i in range(11):
        log(root / "p" / f"s{i:02}.jsonl", f"question {i}", "answer")
    e = Engine(spark, str(tmp_path / "store"), [("claude", [str(root)])])
    e.ingest("2026-01-02")
    say = lambda text, previous: "- **Asked:** x"
    assert e.backfill(say, max_batches=1) == 8 and e.backfill(say, only="claude/s10") == 1 and e.backfill(say) == 2 and e.backfill(say) == 0


def test_the_spool_is_emptied(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    for i in range(3):
        (spool / f"{i}.json").write_text(json.dumps({"session_id": str(i), "transcript_path": f"/x{i}"}))
    os.utime(spool / "2.json", (1, 1))
    assert capture.reap(spark, str(spool)) == 1 and sorted(os.listdir(spool)) == ["0.json", "1.json"]
    seen = []
    for k in range(3):
        capture.run(capture.spool(spark, str(spool)), lambda df, n: seen.extend(r["session_id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
        (spool / f"late{k}.json").write_text(json.dumps({"session_id": f"late{k}", "transcript_path": "/y"}))
    assert sorted(seen) == ["0", "1", "late0", "late1"] and "0.json" not in os.listdir(spool)


def test_legacy_reader_and_linear_folds(spark, tmp_path):
    good = {"source": "claude", "session_id": "a", "keywords": ["x"], "files": [["M", "p"]]}
    (tmp_path / "old.jsonl").write_text(json.dumps(good) + "\n\nnot json\n[1]\n" + json.dumps({"source": "codex"}) + "\n")
    rows, bad = store.read_legacy(spark, str(tmp_path / "old.jsonl"))
    assert bad == 2 and [r["session_id"] for r in rows.collect()] == ["a", None] and rows.first()["files"] == [["M", "p"]]
    items = [("M", "a"), ("D", "b"), ("C", "a"), ("D", "c"), ("M", "b"), ("D", "a")]
    d = spark.createDataFrame([(items,), ([],)], "f array<struct<op:string,path:string>>")
    got = [[tuple(x) for x in r[0]] for r in d.select(fold.manifest(F.col("f"))).collect()]
    assert got == [[("C", "a"), ("M", "b"), ("D", "c")], []]
    assert [[tuple(x) for x in r[0]] for r in d.select(fold.firsts(F.col("f"), "path")).collect()] == [[("M", "a"), ("D", "b"), ("D", "c")], []]
    many = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.struct(F.lit("M").alias("op"), F.concat(F.lit("p"), (i % 30_000).cast("string")).alias("path"))).alias("f"))
    assert many.select(F.size(fold.manifest(F.col("f")))).first()[0] == 30_000
    long = spark.range(1).select(T.scrub_text(F.concat(F.lit("/"), F.repeat(F.lit("x"), 400_000), F.lit(" /h/private-notes/y")), ["**/private-notes/**"]).alias("t"))
    assert long.first()["t"].endswith(" [excluded-path]")
