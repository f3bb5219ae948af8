"""Both log families, from hand-written files to session rows."""

import json

from pyspark.sql import functions as F

from threadmill.sources import logs


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def block(kind, **k):
    return {"type": kind, **k}


def test_first_family(spark, tmp_path):
    root = tmp_path / "projects"
    use = lambda name, i, **k: block("tool_use", name=name, id=i, input=k)
    write(root / "-home-me-shop" / "aa-1.jsonl", [
        {"type": "user", "cwd": "/home/me/shop", "timestamp": "2026-01-02T03:04:05Z", "message": {"role": "user", "content": "Add a cart with docker <private>pin 1</private>"}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}}, "not json", "", "[1, 2]",
        {"type": "assistant", "message": {"model": "m-1", "content": [block("text", text=" On it. "), use("Bash", "b1", command="git push origin cart/x && rm old.py"), use("Write", "w", file_path="/home/me/shop/cart.py"), use("Edit", "e", file_path="/home/me/shop/cart.py"),
                                                                        use("TodoWrite", "t", todos='[{"content": "pay", "status": "open"}, {"content": "x", "status": "completed"}]'), use("Skill", "s", skill="review"), use("Task", "a", subagent_type="helper"),
                                                                        use("mcp__plugin_tools_browser__click", "m"), use("Bash", "b2", command="pytest -q")]}},
        {"type": "user", "message": {"content": [block("tool_result", tool_use_id="b1", content="[cart 1234567] Add cart\nhttps://github.com/me/shop/pull/7"), block("tool_result", tool_use_id="b2", content=[block("text", text="2 failed, 3 passed")])]}},
        {"type": "assistant", "message": {"model": "<synthetic>", "content": [block("text", text="All merged.")]}},
        {"type": "unknown"},
    ])
    write(root / "p" / "side.jsonl", [{"type": "user", "isSidechain": True, "message": {"content": "hi"}}])
    write(root / "p" / "subagents" / "x.jsonl", [{"type": "user", "message": {"content": "hi"}}])
    write(root / "p" / "own.jsonl", [{"type": "user", "message": {"content": "@@S1@@ summarize"}}])
    write(root / "p" / "quiet.jsonl", [{"type": "assistant", "message": {"content": [block("text", text="x")]}}])
    write(root / "-home-me-lib" / "bb-2.jsonl", [{"type": "user", "message": {"content": "no folder here"}}])
    got = {r["sid"]: r for r in logs.extract(spark, [str(root)], "claude").collect()}
    assert set(got) == {"claude/aa-1", "claude/bb-2"}
    r = got["claude/aa-1"]
    assert (r["cwd"], r["model"], r["repo"], r["branch"], r["date"], r["parse_warnings"]) == ("/home/me/shop", "m-1", "me/shop", "cart/x", "2026-01-02", 1)
    assert r["excerpt"] == "USER: Add a cart with docker [private]\n\nASSISTANT: On it.\n\nASSISTANT: All merged." and r["resolved"] == "done"
    assert [tuple(f) for f in r["files"]] == [("D", "old.py"), ("C", "cart.py")] and [tuple(c) for c in r["commits"]] == [("1234567", "Add cart")]
    assert r["prs"] == ["https://github.com/me/shop/pull/7"] and r["skills"] == ["review"] and r["mcp"] == ["browser"] and [tuple(s) for s in r["subagents"]] == [("helper", 1)]
    assert tuple(r["tests"]) == ("3 passed, 2 failed", True) and r["open_todos"] == ["pay"] and r["keywords"] == ["docker", "pytest", "git"]
    assert got["claude/bb-2"]["cwd"] == "/home/me/lib"


def test_second_family(spark, tmp_path):
    uuid = "7d1c35aa-92b4-4e0f-a6d3-5b8f0e21c794"
    head = lambda **k: {"type": "session_meta", "payload": {"id": uuid, "originator": "tui", "thread_source": "user", "cwd": "/w", **k}}
    item = lambda **k: {"type": "event_msg", "payload": {"type": "item_completed", "item": k}}
    response = lambda **k: {"type": "response_item", "timestamp": "2026-02-03T00:00:00Z", "payload": k}
    root = tmp_path / "sessions"
    write(root / "2026" / f"rollout-2026-02-03T00-00-00-{uuid}.jsonl", [
        head(forked_from_id="f"), {"type": "turn_context", "payload": {"model": "q-2"}},
        {"type": "event_msg", "timestamp": "2026-02-03T01:00:00Z", "payload": {"type": "user_message", "message": "Fix  it"}},
        response(type="message", role="user", content=[{"type": "input_text", "text": "Fix it"}]), response(type="message", role="user", content=[{"type": "input_text", "text": "<env>x</env>"}]),
        response(type="message", role="user", content=[{"type": "input_text", "text": "# AGENTS.md instructions for x"}]),
        response(type="message", role="developer", content=[{"type": "input_text", "text": "no"}]), {"type": "compacted"},
        response(type="custom_tool_call", call_id="c1", input="tools.exec_command({cmd: \"git push origin b-1\\n\"}); x({cmd: 'ls -a'})"),
        response(type="custom_tool_call_output", call_id="c1", output=[{"type": "text", "text": "https://github.com/o/r/pull/3"}]),
        item(type="CommandExecution", id="c2", command=["/bin/sh", "-lc", "go test ./..."], stdout="ok", stderr=""), item(type="FileChange", changes={"/w/a.b/c.go": {"type": "add"}, "/w/z": {"type": "odd"}}),
        item(type="McpToolCall", server="docs"), item(type="CollabAgentToolCall", receiver_agents=[{"agent_nickname": "kit"}, {}]), item(type="CollabAgentToolCall", tool="spawn_agent"), item(type="Plan", plan=[{"step": "one", "status": "open"}]),
        response(type="function_call", name="exec_command", call_id="c3", arguments='{"cmd": "echo hi"}'), response(type="function_call_output", call_id="c3", output="hi"),
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "Should I go on?"}}, "{bad",
    ])
    write(root / "rollout-2026-exec.jsonl", [head(originator="Codex Exec"), {"type": "event_msg", "payload": {"type": "user_message", "message": "x"}}])
    write(root / "history.jsonl", [head()])
    r = logs.extract(spark, [str(root)], "codex").collect()
    assert len(r) == 1
    r = r[0]
    assert (r["sid"], r["cwd"], r["model"], r["client"], r["forked_from"], r["date"], r["parse_warnings"]) == (f"codex/{uuid}", "/w", "q-2", "tui", "f", "2026-02-03", 1)
    assert r["excerpt"] == "USER: Fix  it\n\nASSISTANT: Should I go on?" and r["resolved"] == "open" and [tuple(b)[0] for b in r["boundaries"]] == [1]
    assert r["branch"] == "b-1" and r["prs"] == ["https://github.com/o/r/pull/3"] and r["repo"] == "o/r" and tuple(r["tests"]) == ("passed", False)
    assert [tuple(f) for f in r["files"]] == [("C", "a.b/c.go")] and r["mcp"] == ["docs"] and [tuple(s) for s in r["subagents"]] == [("kit", 1), ("agent", 2)]
    assert r["open_todos"] == ["one"] and "go" in r["keywords"]


def test_paths(spark):
    rows = [("/r/a/rollout-1-a-b-c-d-e.jsonl",), ("/r/x.jsonl",), ("/q/-home/x.jsonl",), ("/q/x.jsonl",), ("/r/x.txt",)]
    d = spark.createDataFrame(rows, "path string").withColumn("f", logs.family(F.col("path"), "/r"))
    assert [r["f"] for r in d.collect()] == ["codex", "claude", "claude", None, None]
    assert [r[0] for r in d.select(logs.watermark_key(F.col("path"), F.col("f"))).collect()][:2] == ["codex:a-b-c-d-e", "claude:x"]
