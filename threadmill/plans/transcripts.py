"""Transcript files of both log families written from the conversations, so that the sources can be queried like any table.

Every conversation becomes one file. What its lines hold besides the turns follows from the turn's number, as in the lenses.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from threadmill.functions.workers import importable, shared_folder
from threadmill.plans.lens import lens


def first_family(i: int, role: str, text: str) -> list[dict]:
    tool = lambda name, **k: {"type": "tool_use", "name": name, "id": f"t{i}", "input": k}
    if role == "user":
        lines: list[dict] = [{"type": "user", "cwd": "/home/u/shop", "timestamp": f"2024-05-{1 + i % 28:02}T10:00:00Z", "message": {"content": text}}]
        if i % 3 == 0:
            lines.append({"type": "user", "isMeta": True, "message": {"content": "not said"}})
        return lines
    blocks: list[dict] = [{"type": "text", "text": text}, tool("Write" if i % 4 == 1 else "Edit", file_path=f"/home/u/shop/src/f{i % 5}.py"), tool("Skill", skill=f"skill{i % 3}"), tool(f"mcp__srv{i % 2}__call")]
    blocks += [tool("TodoWrite", todos=[{"content": f"step {i}", "status": "open" if i % 2 else "completed"}]), tool("Task", subagent_type="helper"), tool("Bash", command="pytest -q")]
    out = {"type": "tool_result", "tool_use_id": f"t{i}", "content": f"[main {i:07x}] Change {i}" if i % 4 == 1 else [{"type": "text", "text": f"{i} passed"}]}
    return [{"type": "assistant", "message": {"model": f"m-{i % 3}", "content": blocks}}, {"type": "user", "message": {"content": [out]}}]


def second_family(i: int, role: str, text: str) -> list[dict]:
    note = lambda **k: {"type": "event_msg", "timestamp": f"2024-05-{1 + i % 28:02}T10:00:00Z", "payload": k}
    item = lambda **k: note(type="item_completed", item=k)
    response = lambda **k: {"type": "response_item", "payload": k}
    part = "input_text" if role == "user" else "output_text"
    lines = [note(type="user_message" if role == "user" else "agent_message", message=text), response(type="message", role=role, content=[{"type": part, "text": text}])]
    if role != "user":
        lines += [{"type": "turn_context", "payload": {"model": f"m-{i % 3}"}}, item(type="FileChange", changes={f"/w/f{i % 5}.py": {"type": "add" if i % 4 == 1 else "update"}}), item(type="McpToolCall", server=f"srv{i % 2}")]
        lines += [item(type="CommandExecution", id=f"c{i}", command=["sh", "-lc", "pytest -q"], stdout=f"{i} passed", stderr=""), item(type="Plan", plan=[{"step": f"step {i}", "status": "open" if i % 2 else "completed"}])]
        lines += [response(type="function_call", name="spawn_agent", call_id="a", arguments=json.dumps({"agent_type": "helper"})), response(type="custom_tool_call", call_id=f"j{i}", input="run({cmd: 'git checkout -b side'})"), {"type": "compacted"}]
    return lines


def written(spark: SparkSession, sf_dir: str, family: str) -> str:
    """The folder of the files; every fifth conversation's has a line that is no JSON, every seventh's may not be read."""
    importable(spark)
    root = shared_folder(spark, f"logs-{family}")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = pafs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for part in parts:
            for conv, rows in part.groupby("conv_id"):
                out: list[str] = []
                for i, role, text in sorted(zip(rows["ord"], rows["role"], rows["text"])):
                    out += [json.dumps(x) for x in (first_family if family == "claude" else second_family)(int(i), role, text)]
                if conv % 5 == 0:
                    out.append("{cut off")
                if family == "claude":
                    folder, name = f"{path}/-home-u-shop{'/subagents' if conv % 7 == 0 else ''}", f"c{conv}.jsonl"
                else:
                    folder, name = f"{path}/2024/05", f"rollout-2024-05-01T00-00-00-{conv:08}-0000-4000-8000-000000000000.jsonl"
                    out.insert(0, json.dumps({"type": "session_meta", "payload": {"originator": "codex exec" if conv % 7 == 0 else "tui", "thread_source": "user", "cwd": "/w"}}))
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/{name}") as f:
                    f.write(("\n".join(out) + "\n").encode())
            yield pd.DataFrame({"n": [len(part)]})

    turns: DataFrame = lens(spark, sf_dir, "turns").where("text is not null").select("conv_id", "ord", "role", "text")
    # a conversation's file is written by one task, as a transcript is by one session
    turns.groupBy("conv_id").applyInPandas(lambda p: next(write(iter([p]))), "n long").count()
    return root
