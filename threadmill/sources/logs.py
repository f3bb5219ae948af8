"""Transcript files as lines, and lines as the events that the fold reads.

Files are listed without being read (``files``), so that a caller can drop those it knows; the rest is read as lines, which Spark splits
within a file, too. A line's place is the start of its split and its number in the scan. Each line is parsed to VARIANT once and
turned into an array of events, which is exploded; a line that is no JSON counts as a warning. An adapter is a function
``lines -> events``; everything after it is shared. Files that vanish or are cut off while they are read yield what could be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import text as T

#: An event of a line: its place in the line, and what the fold reads.
EVENT = "struct<at:bigint,kind:string,role:string,a:string,b:string,call_id:string,ts:string,channel:string>"
#: Places in a line: of its parts, and of what stands behind all parts.
BLOCK, LAST = 1_000_000, 1 << 60


def files(spark: SparkSession, roots: list[str], family: str) -> DataFrame:
    """path, modificationTime and length below the roots: one family's files only, none of them read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if family == "codex":
        found = reader.option("pathGlobFilter", "rollout-*.jsonl").load(roots)
    else:
        found = reader.option("pathGlobFilter", "*.jsonl").load(roots).where(~F.contains("path", F.lit("/subagents/")))
    return found.select("path", "modificationTime", "length")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, mtime, size, place and text of the lines of some files."""
    if not paths:
        return spark.createDataFrame([], "path string, mtime timestamp, size bigint, place struct<start:bigint,row:bigint>, line string")
    raw = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").option("lineSep", "\n").text(paths)
    m = F.col("_metadata")
    # the reader's metadata writes paths as URIs, the listing does not
    path = F.regexp_replace(F.url_decode(F.replace(m["file_path"], F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    place = F.struct(m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("row"))
    return raw.select(path.alias("path"), m["file_modification_time"].alias("mtime"), m["file_size"].alias("size"), place.alias("place"), F.col("value").alias("line"))


def parsed(rows: DataFrame) -> DataFrame:
    """The non-blank lines with v, null where a line is no JSON; what is JSON but no object goes."""
    d = rows.where(F.rlike("line", F.lit(r"\S"))).withColumn("v", F.try_parse_json("line")).drop("line")
    return d.where(F.col("v").isNull() | F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def is_string(v: Column | str, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(get(v, path, "variant")) == "STRING", F.lit(False))


def text_of(v: Column | str, path: str) -> Column:
    """A string value; null for any other kind."""
    return F.when(is_string(v, path), get(v, path))


def event(when: Column, kind: str, at=0, role=None, a=None, b=None, call_id=None, ts=None, channel=None) -> Column:
    """One event, or null where ``when`` doesn't hold."""
    values = {"at": at, "kind": kind, "role": role, "a": a, "b": b, "call_id": call_id, "ts": ts, "channel": channel}
    made = F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in values.items())).cast(EVENT)
    return F.when(F.coalesce(when, F.lit(False)), made)


def none() -> Column:
    return F.array().cast(f"array<{EVENT}>")


def each(items: Column, make) -> Column:
    """The events that ``make(item, index)`` lists for every item, end to end."""
    return F.coalesce(F.flatten(F.transform(items, make)), none())


def explode(rows: DataFrame, events: Column, *kept: str) -> DataFrame:
    """One row for each event; ``ord`` orders those of a session."""
    d = rows.select("sid", "place", *kept, F.inline(F.array_compact(events)))
    return d.select("sid", F.struct(F.col("place.start").alias("start"), F.col("place.row").alias("row"), F.col("at").alias("at")).alias("ord"), "kind", "role", "a", "b", "call_id", "ts", "channel", *kept)


def parts(v: Column | str, path: str, kinds: list[str] | None) -> Column:
    """Texts of a list of typed parts; with ``kinds`` also the plain strings among them."""
    def said(p: Column) -> Column:
        typed = F.when(get(p, "$.type").isin(kinds or ["text"]), text_of(p, "$.text"))
        return F.coalesce(text_of(p, "$"), typed) if kinds else typed

    return F.array_compact(F.transform(get(v, path, "array<variant>"), said))


def filled(texts: Column) -> Column:
    return F.filter(texts, lambda x: x != "")


def claude_sid(path: Column) -> Column:
    return F.concat(F.lit("claude/"), F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.jsonl$", ""))


def claude_events(rows: DataFrame) -> DataFrame:
    """Events of the first log family: messages with content blocks."""
    d = parsed(rows).withColumn("sid", claude_sid(F.col("path")))
    kind, content = get("v", "$.type"), "$.message.content"
    said = F.coalesce(F.array_join(filled(F.transform(parts("v", content, None), T.trim_all)), "\n"), F.lit(""))
    human = (kind == "user") & ~F.coalesce(get("v", "$.isMeta", "boolean"), F.lit(False)) & is_string("v", content)
    line = F.array(
        event(F.col("v").isNull(), "bad"), event(text_of("v", "$.cwd").isNotNull(), "cwd", a=text_of("v", "$.cwd")), event(get("v", "$.isSidechain", "boolean"), "sidechain"),
        event(kind == "assistant", "model", LAST, a=text_of("v", "$.message.model")), event(human, "turn", LAST, role="USER", b=get("v", content), ts=text_of("v", "$.timestamp")),
        event((kind == "assistant") & (said != ""), "turn", LAST, role="ASSISTANT", b=said))

    def block(k: Column, i: Column) -> Column:
        at, what, name = i.cast("long") * BLOCK, get(k, "$.type"), get(k, "$.name")
        tool, result = what == "tool_use", what == "tool_result"
        path = text_of(k, "$.input.file_path")
        todos = F.coalesce(text_of(k, "$.input.todos"), F.to_json(get(k, "$.input.todos", "variant")))
        own = F.array(
            event(tool & (name == "Bash"), "command", at, a=text_of(k, "$.input.command"), call_id=get(k, "$.id")), event(tool & (name == "Write"), "file", at, a="C", b=path),
            event(tool & name.isin("Edit", "NotebookEdit"), "file", at, a="M", b=path), event(tool & (name == "TodoWrite"), "todos", at, b=todos),
            event(tool & (name == "Skill"), "skill", at, a=text_of(k, "$.input.skill")), event(tool & name.isin("Agent", "Task"), "subagent", at, a=text_of(k, "$.input.subagent_type")),
            event(tool & F.startswith(name, F.lit("mcp__")), "mcp", at, a=T.mcp_label(name)), event(what == "text", "text", at, b=text_of(k, "$.text")))
        texts = F.when(is_string(k, "$.content"), F.array(get(k, "$.content"))).otherwise(parts(k, "$.content", None))
        return F.concat(own, each(F.when(result, texts), lambda x, j: F.array(event(F.lit(True), "output", at + j, b=x, call_id=get(k, "$.tool_use_id")))))

    return explode(d, F.concat(line, each(F.when(~is_string("v", content), get("v", content, "array<variant>")), block))).drop("channel")


def denied(originator: Column) -> Column:
    folded = F.lower(F.regexp_replace(F.trim(originator), r"[\s_]+", "-"))
    return F.coalesce(originator, F.lit("")).isin("") | folded.isin(*P.DENIED_ORIGINATORS)


def codex_headers(rows: DataFrame) -> DataFrame:
    """path, sid and session fields of the rollouts whose first line admits them."""
    p = "$.payload"
    first = rows.where(F.col("place.start") == 0).groupBy("path").agg(F.min_by("line", "place").alias("line")).withColumn("v", F.try_parse_json("line"))
    h = first.where((get("v", "$.type") == "session_meta") & (get("v", f"{p}.thread_source") == "user")).where(~denied(text_of("v", f"{p}.originator")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    uuid = F.coalesce(F.nullif(text_of("v", f"{p}.id"), F.lit("")), T.rollout_uuid(name))
    return h.select("path", F.concat(F.lit("codex/"), uuid).alias("sid"), text_of("v", f"{p}.cwd").alias("cwd"), text_of("v", f"{p}.originator").alias("client"),
                    F.coalesce(text_of("v", f"{p}.forked_from_id"), text_of("v", f"{p}.parent_thread_id")).alias("forked_from"))


def _unescape(raw: Column) -> Column:
    read = F.try_parse_json(F.concat(F.lit('"'), F.replace(raw, F.lit("\n"), F.lit("\\n")), F.lit('"')))
    return F.coalesce(F.try_variant_get(read, "$", "string"), raw)


def argv_command(v: Column | str, path: str) -> Column:
    """A command given as a string, as a shell's argument, or as words."""
    words = F.array_compact(F.transform(get(v, path, "array<variant>"), lambda x: text_of(x, "$")))
    shell = F.coalesce(F.get(words, F.lit(1)), F.lit("")).isin("-c", "-lc", "-ic", "-lic") & (F.size(words) >= 3)
    return F.when(is_string(v, path), get(v, path)).when(shell, F.get(words, F.lit(2))).otherwise(F.nullif(F.array_join(words, " "), F.lit("")))


def steps(v: Column, path: str, names: tuple[str, ...]) -> Column:
    """A plan as the JSON list of its steps."""
    return F.to_json(F.transform(get(v, path, "array<variant>"), lambda x: F.struct(F.coalesce(*(get(x, f"$.{n}") for n in names)).alias("content"), get(x, "$.status").alias("status"))))


def codex_events(rows: DataFrame) -> DataFrame:
    """Events of the second log family: typed payloads, two channels for turns."""
    v, p = F.col("v"), "$.payload"
    heads = codex_headers(rows).select("path", "sid")
    d = parsed(rows).join(heads, "path")
    t, pt = get(v, "$.type"), get(v, f"{p}.type")
    note, response = t == "event_msg", t == "response_item"
    item = note & (pt == "item_completed")
    kind, call = get(v, f"{p}.item.type"), get(v, f"{p}.item.id")
    joined = lambda path: F.when(is_string(v, path), get(v, path)).otherwise(F.coalesce(F.array_join(filled(parts(v, path, P.TEXT_PARTS)), "\n"), F.lit("")))
    when = text_of(v, "$.timestamp")

    def turn(holds: Column, role: Column, text: Column, channel: str, ts=None) -> Column:
        left = F.regexp_replace(text, r"^\s+", "")
        injected = (role == "USER") & (F.startswith(left, F.lit("<")) | F.startswith(F.lower(left), F.lit(P.INJECTED_PREFIX)))
        return event(holds & (left != "") & ~injected, "turn", role=role, b=text, ts=ts, channel=channel)

    command, streams = item & (kind == "CommandExecution"), F.nullif(F.array_join(filled(F.array_compact(F.array(text_of(v, f"{p}.item.stdout"), text_of(v, f"{p}.item.stderr")))), "\n"), F.lit(""))
    plan = F.coalesce(steps(v, f"{p}.item.plan", ("step", "content", "text")), steps(v, f"{p}.item.steps", ("step", "content", "text")))
    output, said = response & pt.isin("function_call_output", "custom_tool_call_output"), joined(f"{p}.output")
    calls, name = response & (pt == "function_call"), get(v, f"{p}.name")
    arguments = F.when(is_string(v, f"{p}.arguments"), F.try_parse_json(get(v, f"{p}.arguments"))).otherwise(get(v, f"{p}.arguments", "variant"))
    own = get(v, f"{p}.call_id")
    line = F.array(
        event(v.isNull(), "bad"), event(t == "compacted", "boundary", a="precompact", b="auto"), event(t == "turn_context", "model", a=text_of(v, f"{p}.model")),
        turn(note & (pt == "user_message"), F.lit("USER"), text_of(v, f"{p}.message"), "event", when), turn(note & (pt == "agent_message"), F.lit("ASSISTANT"), text_of(v, f"{p}.message"), "event"),
        turn(response & (pt == "message") & get(v, f"{p}.role").isin("user", "assistant"), F.upper(get(v, f"{p}.role")), joined(f"{p}.content"), "item", when),
        event(note & (pt == "mcp_tool_call_end"), "mcp", a=text_of(v, f"{p}.invocation.server")), event(item & (kind == "McpToolCall"), "mcp", a=text_of(v, f"{p}.item.server")),
        event(command, "command", a=argv_command(v, f"{p}.item.command"), call_id=call), event(command & streams.isNotNull(), "output", 1, b=streams, call_id=call),
        event(item & (kind == "Plan") & plan.isNotNull(), "todos", b=plan), event(output & (said != ""), "output", b=said, call_id=own),
        event(calls & (name == "exec_command"), "command", a=text_of(arguments, "$.cmd"), call_id=own), event(calls & (name == "spawn_agent"), "subagent", a=text_of(arguments, "$.agent_type")),
        event(calls & (name == "update_plan") & get(arguments, "$.plan", "array<variant>").isNotNull(), "todos", b=steps(arguments, "$.plan", ("step",))))

    ops = F.create_map(*(F.lit(x) for kv in P.PATCH_OPS.items() for x in kv))
    changed = F.when(note & (pt == "patch_apply_end") & get(v, f"{p}.success", "boolean"), get(v, f"{p}.changes", "map<string,variant>")).when(item & (kind == "FileChange"), get(v, f"{p}.item.changes", "map<string,variant>"))
    op = lambda e: F.try_element_at(ops, F.coalesce(get(e["value"], "$.type"), F.lit("")))
    files_ = each(F.map_entries(changed), lambda e, i: F.array(event(op(e).isNotNull(), "file", i, a=op(e), b=e["key"])))
    team, listed = item & (kind == "CollabAgentToolCall"), get(v, f"{p}.item.receiver_agents", "array<variant>")
    agents = each(F.when(team, listed), lambda g, i: F.array(event(F.lit(True), "subagent", i, a=F.coalesce(F.nullif(get(g, "$.agent_nickname"), F.lit("")), F.lit("agent")))))
    spawned = F.array(event(team & (F.coalesce(F.size(listed), F.lit(0)) < 1) & (get(v, f"{p}.item.tool") == "spawn_agent"), "subagent", a="agent"))
    script = F.when(response & (pt == "custom_tool_call"), text_of(v, f"{p}.input"))
    hits = F.concat(*(F.regexp_extract_all(script, F.lit(rf"\bcmd\s*:\s*{q}((?:[^{q}\\]++|\\.)*+){q}"), F.lit(1)) for q in ('"', "'")))
    scripted = each(filled(hits), lambda raw, i: F.array(event(F.lit(True), "command", i, a=_unescape(raw), call_id=F.when(i == 0, own))))
    from threadmill.operators.fold import dedupe_channels

    found = explode(d, F.concat(line, files_, agents, spawned, scripted))
    turns = dedupe_channels(found.where("kind = 'turn'"))
    started = codex_headers(rows).select("sid", F.lit(None).cast("struct<start:bigint,row:bigint>").alias("place"), "cwd")
    started = explode(started, F.array(event(F.lit(True), "cwd", a=F.col("cwd"))))
    return turns.unionByName(found.where("kind <> 'turn'")).unionByName(started).drop("channel")


def family(path: Column, claude_root: str) -> Column:
    """Which adapter a single path belongs to; null for none."""
    name, parent = F.regexp_extract(path, r"([^/]+)$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    jsonl = F.endswith(name, F.lit(".jsonl"))
    inside = F.startswith(path, F.lit(claude_root.rstrip("/") + "/")) | F.startswith(parent, F.lit("-"))
    return F.when(F.rlike(name, F.lit(r"^rollout-.*\.jsonl$")), "codex").when(jsonl & inside, "claude")


def watermark_key(path: Column, kind: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.jsonl$", "")
    return F.when(kind == "claude", F.concat(F.lit("claude:"), stem)).when(kind == "codex", F.concat(F.lit("codex:"), T.rollout_uuid(stem))).otherwise(F.concat(F.lit("path:"), path))


def keyed(found: DataFrame, kind: str) -> DataFrame:
    """key, path, mtime and size of listed files; of several files of one session, as while it moves to an archive, the latest."""
    d = found.select(watermark_key(F.col("path"), F.lit(kind)).alias("key"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    return d.groupBy("key").agg(F.max_by(F.struct("path", "mtime", "size"), F.struct("mtime", "path")).alias("f")).select("key", "f.*")


def extract(spark: SparkSession, roots: list[str], kind: str) -> DataFrame:
    """Session rows of all files of one family."""
    return extract_files(spark, [r["path"] for r in keyed(files(spark, roots, kind), kind).select("path").collect()], kind)


def extract_files(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Session rows of some files of one family. The paths are a listing, as the reader itself holds on the driver."""
    from threadmill.operators.fold import sessions

    rows = lines(spark, paths)
    events = claude_events(rows) if kind == "claude" else codex_events(rows)
    keys = rows.groupBy("path").agg(F.max("mtime").alias("mtime"), F.max("size").alias("size"))
    keys = keys.withColumn("sid", claude_sid(F.col("path"))) if kind == "claude" else keys.join(codex_headers(rows).select("path", "sid", "client", "forked_from"), "path")
    # a session in two files, as after a move to an archive, is the later file's
    keys = keys.groupBy("sid").agg(F.max_by(F.struct(*keys.columns), F.struct("mtime", "path")).alias("k")).select("k.*")
    s = sessions(events).join(keys, "sid")
    day = F.coalesce(F.date_format(T.parse_ts(F.col("first_ts")), "yyyy-MM-dd"), F.date_format("mtime", "yyyy-MM-dd"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    guess = F.replace(F.regexp_replace(folder, "^-", "/"), F.lit("-"), F.lit("/"))
    return s.withColumn("harness", F.lit(kind)).withColumn("native_id", T.sid_uuid(F.col("sid"))).withColumn("date", day).withColumn("last_active", F.coalesce("last_ts", F.lit(""))).withColumn(
        "cwd", F.when((F.col("cwd") == "") & (F.lit(kind) == "claude"), guess).otherwise(F.col("cwd"))).withColumn("summary_state", F.lit("pending"))
