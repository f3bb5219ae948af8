"""Search against an FTS engine, globs, segments, the store and the stream."""

import fnmatch
import json
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.functions import text as T
from threadmill.functions.porter import stem
from threadmill.operators import search, segments, store
from threadmill.streaming import capture

DOCS = ["Fixing the auth-token in src/auth.py now", "the authenticated user authenticates; fixes done.", "relational conditional hopefulness of ponies caresses", "fix fix fix the bug. a bug", "nothing here at all", "Café fixation hopping falling agreed plastered motoring sized", "My résumé: run git push, then git-push or push again; git push"]


def fts(tokenizer):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(x, tokenize=\"{tokenizer}\")")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(DOCS)))
    return lambda q: {r[0]: -r[1] for r in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (q,))}


@pytest.mark.parametrize("terms", [["fix"], ["the", "fix"], ["authenticate"], ["bug."], ["src/auth.py"], ["cafe"], ["hop"], ["missing"], ["the bug"], ["fix fix"], ["fixes done", "the"], ["RÉSUMÉ"], ["git push"], ["push git"], ["café fixation"], ["authenticated user"]])
def test_word_scores_are_fts(spark, terms):
    d = spark.createDataFrame(list(enumerate(DOCS)), "sid long, x string")
    index, lengths = search.postings(d, "sid", ["x"], stemmed=True)
    got = {r["sid"]: r["score"] for r in search.score_words(index, lengths, terms, stemmed=True).collect()}
    want = fts("porter unicode61 tokenchars '-_./'")(" ".join(f'"{t}"' for t in terms))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in got)


@pytest.mark.parametrize("terms", [["fix"], ["auth"], ["the ", "bug"], ["zzz"], ["xy"]])
def test_trigram_scores_are_fts(spark, terms):
    d = spark.createDataFrame(list(enumerate(DOCS)), "sid long, x string")
    got = {r["sid"]: r["score"] for r in search.score_trigrams(d, "sid", F.lower("x"), terms).collect()}
    long = [t for t in terms if len(t) > 2]
    want = fts("trigram")(" ".join(f'"{t}"' for t in long)) if long else {}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in got)


def test_stems_are_fts():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer radically differently analogous vietnamization predication operator feudalism decisiveness hopefulness callousness formality sensitivity triplicate formative formalize electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologous communism activate angularity effective bowdlerize probate rate cease controlling rolling generalizations oscillators yes by".split()
    for w in words:
        db.execute("DELETE FROM t")
        db.execute("INSERT INTO t VALUES (?)", (w,))
        assert stem(w) == db.execute("SELECT term FROM v").fetchone()[0], w


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab/*?[]!.-\n", max_size=8), st.text(alphabet="ab/*!.-\n", max_size=8))
def test_globs_are_fnmatch(glob, path):
    import re

    pattern = T.glob_regex(glob).replace("[^]", "[^\\]")
    try:
        mine = re.search(pattern[:-2] + ")\\Z" if pattern.endswith(")$") else pattern, path) is not None
    except re.error:
        return
    if not set("[]") & set(glob):
        assert mine == fnmatch.fnmatchcase(path, glob)


def test_scrubbing_is_idempotent(spark):
    globs = ["**/private-notes/**"]
    d = spark.createDataFrame([("see /h/private-notes/a.md, ~/ok/b.py and -h-private-notes/c",), ("plain",)], "x string").select(T.scrub_text(F.col("x"), globs).alias("x"))
    once = [r[0] for r in d.collect()]
    assert once == ["see [excluded-path], ~/ok/b.py and [excluded-path]", "plain"] and once == [r[0] for r in d.select(T.scrub_text(F.col("x"), globs)).collect()]


def test_segments_tile_and_close(spark):
    one = spark.range(1).select(segments.no_segments().alias("s"))
    s = F.col("s")
    cut = lambda d, **k: d.withColumn("s", segments.append(s, F.lit("stop"), F.lit(k.pop("n")), F.lit(1), F.lit("t"), **k))
    ranges = lambda d: [(x["seq"], x["start"], x["end"], x["state"]) for x in d.first()["s"]]
    a = cut(one, n=5)
    assert ranges(a) == [(1, 0, 5, "pending")] and ranges(cut(a, n=9)) == ranges(a) and ranges(cut(a, n=9, force=True))[1] == (2, 5, 9, "pending")
    done = a.withColumn("s", segments.close(s, F.lit(1), F.struct(F.lit("x").alias("asked"), *(F.lit(None).cast("string").alias(k) for k in ("learned", "completed", "left_off", "next_steps")))))
    assert ranges(done) == [(1, 0, 5, "done")] and done.first()["s"][0]["summary"]["learned"] == "" and ranges(cut(done, n=8, min_turns=4)) == ranges(done)
    assert ranges(cut(done, n=9, min_turns=4))[1] == (2, 5, 9, "pending") and ranges(cut(done, n=5, force=True))[1] == (2, 0, 5, "pending")
    assert ranges(a.withColumn("s", segments.close(s, F.lit(1), None))) == [(1, 0, 5, "error")] and ranges(cut(one, n=0, force=True)) == []
    assert one.select(segments.split_turns(F.lit("USER: a\nb\n\nASSISTANT: c"))).first()[0] == ["USER: a\nb", "ASSISTANT: c"]
    assert ranges(one.withColumn("s", segments.backfill(s, F.lit(3), F.lit(1), F.lit("t")))) == [(1, 0, 3, "pending")]


def test_store_versions_and_upsert(spark, tmp_path):
    at = store.Store(spark, str(tmp_path / "s"))
    assert at.read("sessions") is None
    kind = "sid string, cwd string, summary_state string, files array<struct<op:string,path:string>>"
    old = spark.createDataFrame([("a", "/w", "done", [("M", "x/private-notes/y")]), ("b", "/x/private-notes", "done", []), ("c", "/w", "done", [])], kind)
    at.write("sessions", old)
    new = spark.createDataFrame([("a", "/w2", "pending", [("C", "k")]), ("d", "/w", "pending", [("C", "/q/private-notes/k")]), ("e", "/w", "pending", [])], kind)
    dead = spark.createDataFrame([("e",)], "sid string")
    at.write("sessions", store.upsert(at.read("sessions"), new, dead, ["**/private-notes/**"], ["summary_state"]))
    got = {r["sid"]: r for r in at.read("sessions").collect()}
    assert set(got) == {"a", "c", "d"} and got["a"]["cwd"] == "/w2" and got["a"]["summary_state"] == "done" and tuple(got["d"]["files"][0]) == ("scrubbed", "[excluded-path]")
    again = store.upsert(at.read("sessions"), new, dead, ["**/private-notes/**"], ["summary_state"])
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))


def test_capture_stream(spark, tmp_path):
    spool = tmp_path / "spool"
    spool.mkdir()
    for i, p in enumerate([{"session_id": "s1", "transcript_path": "/a", "hook_event_name": "PreCompact", "trigger": " auto "}, {"session_id": "s1", "transcript_path": "/a", "hook_event_name": "Stop"}, {"session_id": "s2", "transcript_path": "/b", "reason": "x"}, {}]):
        (spool / f"{i}.json").write_text(json.dumps(p))
    (spool / "bad.json").write_text("{oops")
    seen, sweeps = [], []
    q = capture.run(capture.spool(spark, str(spool)), lambda df, n: seen.extend(r.asDict() for r in df.collect()), str(tmp_path / "cp"), sweeps.append)
    q.awaitTermination(120)
    assert sorted(r["session_id"] for r in seen) == ["s1", "s2"] and len(sweeps) == 1
    assert [(r["event"], r["trigger"]) for r in seen if r["session_id"] == "s2"] == [("change", "x")]
    seen.clear()
    capture.run(capture.spool(spark, str(spool)), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert seen == []


def test_debounce_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 00:30:00"), ("b", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "k string, t string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t string").json(str(tmp_path / "in")).withColumn("ts", F.col("t").cast("timestamp")).withWatermark("ts", "1 hour")
    q = capture.debounce(stream, "k", "ts").writeStream.format("memory").queryName("calm").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["key"], str(r["ts"])) for r in spark.table("calm").collect()) == [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:30:00"), ("b", "2024-01-01 00:01:00")]
