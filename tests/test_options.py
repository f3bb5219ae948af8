"""Options in a file, and who summarizes what."""

import json

from threadmill import options


def test_options_round_trip(tmp_path):
    o = options.Options("/data/\"s\"", {"claude": ["/a", "/b c"], "codex": []}, ["**/x/**"], "same", {"claude": {"model": "m", "tries": 2, "fast": True}})
    assert options.loads(options.dumps(o), "/d") == o
    path = str(tmp_path / "c" / "options.toml")
    first = options.load(path, "/d", {"claude": [str(tmp_path), "/nowhere/at/all"], "codex": ["/nowhere"]})
    assert first.sources == {"claude": [str(tmp_path)], "codex": []} and options.load(path, "/other") == first
    (tmp_path / "old.toml").write_text('[sources.claude]\nroots = ["/r"]\nenabled = false\n[summarizer]\nprefer = "odd"\n')
    old = options.load(str(tmp_path / "old.toml"), "/d")
    assert old.sources == {} and old.prefer == options.PREFERRED and "version = 2" in (tmp_path / "old.toml").read_text()


def test_engine_of_options(spark, tmp_path):
    root = tmp_path / "logs" / "p"
    root.mkdir(parents=True)
    (root / "a.jsonl").write_text(json.dumps({"type": "user", "cwd": "/w", "message": {"content": "hello"}}) + "\n")
    e = options.Options(str(tmp_path / "store"), {"claude": [str(tmp_path / "logs")], "codex": []}, [], "codex").engine(spark)
    assert e.ingest("2026-01-01")["new"] == 1 and e.backfill({}) == 0
    by = lambda name: lambda text, previous: f"- **Asked:** {name}"
    assert e.backfill({"claude": by("claude"), "codex": by("codex")}) == 1 and e.sessions().first()["summary"]["asked"] == "codex"


def test_a_command_as_summarizer(spark, tmp_path):
    import sys

    from pyspark.sql import functions as F

    from threadmill.operators import segments
    from threadmill.operators.summarizers import command

    script = tmp_path / "answer.py"
    script.write_text("import sys\nt = sys.stdin.read()\nif len(sys.argv) > 1: sys.exit(2)\nprint('@@S1@@\\n- **Asked:** ' + t.strip().split()[-1] + (' again' if 'So far' in t else ''))")
    run = [sys.executable, str(script)]
    ask = command([[*run, "--odd-flag"], ["/no/such/program"], run])
    assert "- **Asked:** there" in ask("hello there", "") and "there again" in ask("hello there", "x")
    assert command([[*run, "--odd-flag"]])("x", "") == "" and command([[sys.executable, "-c", "print(1)"]])("x", "") == "" and command([[sys.executable, "-c", "import time; time.sleep(9)"]], seconds=1)("x", "") == ""
    d = spark.createDataFrame([("claude/a", 1, "one"), ("claude/a", 2, "two")], "sid string, seq int, text string")
    got = {r["seq"]: r["answer"] for r in segments.summarize(d, ask).collect()}
    assert "one" in got[1] and "two again" in got[2]
    text = spark.range(1).select(segments.prompt(F.lit("t"), F.lit("p"), F.lit("stop"))).first()[0]
    assert text == segments.contract("p", "stop") + "t"
