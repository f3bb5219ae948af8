"""The fold: from the events of sessions to one row per session.

Events are rows (sid, ord, kind, role, a, b, call_id, ts); ``ord`` orders a session. Kinds: cwd and model (a), turn (role, b,
ts), command (a), output (b), text (b), file (a: op, b: path), skill, subagent and mcp (a), todos (b: JSON list), boundary
(a: event, b: trigger), sidechain, bad. Everything is one window over (sid, call_id) and one aggregation by sid; columns that
a query does not use are pruned with their aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import text as T


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when & value.isNotNull(), F.col("ord")))


def _last(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when & value.isNotNull(), F.col("ord")))


def _listed(value: Column, when: Column) -> Column:
    """Arrays ``value`` of the rows ``when``, in order, end to end."""
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("ord", value.alias("v"))))), lambda x: x["v"]))


def leaders(items: Column) -> Column:
    """Of structs whose first field is k the least of each k, in the order of k: by a sort, as a look over all for each would be quadratic."""
    ordered = F.array_sort(items)
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda o: o["k"].cast("string")))
    paired = F.arrays_zip(ordered.alias("o"), before.alias("b"))
    return F.transform(F.filter(paired, lambda z: z["o"].isNotNull() & ~z["b"].eqNullSafe(z["o"]["k"].cast("string"))), lambda z: z["o"])


def firsts(items: Column, key: str) -> Column:
    """Items whose key has not come before, in order."""
    found = leaders(F.transform(items, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"), x.alias("x"))))
    return F.transform(F.array_sort(F.transform(found, lambda f: F.struct(f["i"].alias("i"), f["x"].alias("x")))), lambda f: f["x"])


def manifest(shown: Column) -> Column:
    """(op, path) of every path, by its first mention; created outdoes modified, and that deleted."""
    weight = lambda op: F.when(op == "C", -3).when(op == "M", -2).otherwise(-1)
    first = leaders(F.transform(shown, lambda f, i: F.struct(f["path"].alias("k"), i.alias("i"))))
    best = leaders(F.transform(shown, lambda f: F.struct(f["path"].alias("k"), weight(f["op"]).alias("w"))))
    both = F.transform(F.arrays_zip(first.alias("f"), best.alias("b")), lambda z: F.struct(z["f"]["i"].alias("i"), z["b"]["w"].alias("w"), z["f"]["k"].alias("path")))
    return F.transform(F.array_sort(both), lambda z: F.struct(F.element_at(F.array(F.lit("D"), F.lit("M"), F.lit("C")), -z["w"]).alias("op"), z["path"].alias("path")))


def with_commands(events: DataFrame) -> DataFrame:
    """Events with ``said`` (text without private spans), and for outputs the command before it of the same call id
    (``command``) and whether any command of that id was a push or a pull-request operation (``git_op``)."""
    said = T.strip_private(F.when(F.col("kind") == "command", F.col("a")).otherwise(F.col("b")))
    e = events.withColumn("said", said)
    before = Window.partitionBy("sid", "call_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    own = (F.col("kind") == "command") & F.col("call_id").isNotNull() & (F.col("said") != "")
    command = F.last(F.when(own, F.col("said")), ignorenulls=True).over(before)
    git_op = F.max(F.when(own, F.rlike("said", F.lit(P.GIT_OPERATION)))).over(before)
    paired = (F.col("kind") == "output") & F.col("call_id").isNotNull()
    return e.withColumn("command", F.when(paired, command)).withColumn("git_op", F.coalesce(F.when(paired, git_op), F.lit(False)))


def with_turns(events: DataFrame) -> DataFrame:
    """Marks the rows that are turns and trims what they say."""
    trimmed = T.trim_all(F.col("said"))
    user = (F.col("role") == "USER") & ~F.startswith(trimmed, F.lit("<"))
    return events.withColumn("turn", F.when((F.col("kind") == "turn") & (trimmed != "") & (user | (F.col("role") == "ASSISTANT")), trimmed))


def dedupe_channels(turns: DataFrame) -> DataFrame:
    """Of a text that two channels report, the channel that came first is kept, with its own repeats."""
    squashed = T.oneline(F.col("b"))
    w = Window.partitionBy("sid", "role", "_key").orderBy("ord")
    t = turns.withColumn("_key", F.md5(squashed)).withColumn("_first", F.first("channel").over(w))
    return t.where(F.col("channel") == F.col("_first")).drop("_key", "_first")


def sessions(events: DataFrame) -> DataFrame:
    """One row per session that has a user turn, is no sidechain and no summarizer's own talk."""
    e = with_turns(with_commands(events))
    kind = F.col("kind")
    is_turn, command, output, text = F.col("turn").isNotNull(), kind == "command", kind == "output", kind == "text"
    user = is_turn & (F.col("role") == "USER")
    scanned = (output | text) & (F.col("said") != "")
    gitish = F.coalesce(F.rlike("command", F.lit(P.GITISH)), F.lit(False))
    commit = F.transform(F.arrays_zip(F.regexp_extract_all("said", F.lit(P.COMMIT), F.lit(1)).alias("sha"), F.regexp_extract_all("said", F.lit(P.COMMIT), F.lit(2)).alias("subject")),
                         lambda c: F.struct(c["sha"].alias("sha"), _subject(c["subject"]).alias("subject")))
    files = F.when(kind == "file", F.array(F.struct(F.col("a").alias("op"), F.col("b").alias("path")))).otherwise(
        F.transform(T.rm_paths(F.col("said")), lambda p: F.struct(F.lit("D").alias("op"), p.alias("path"))))
    pulls = F.regexp_extract_all("said", F.lit(P.PULL), F.lit(0))
    genuine = user & ~F.rlike("turn", F.lit(r"^(?:/|<|Caveat:|\[Request interrupted)"))
    words = is_turn | command
    dictionary = "(?i)(?<![\\p{L}\\p{N}_])(" + "|".join(k for k in P.KEYWORDS if k not in ("go", "rest")) + ")(?![\\p{L}\\p{N}_])"
    terms = F.transform(F.regexp_extract_all("said", F.lit(dictionary), F.lit(1)), F.lower)
    one = lambda c: F.array(c)
    s = e.groupBy("sid").agg(
        _first(F.col("a"), (kind == "cwd") & (F.col("a") != "")).alias("cwd"),
        _last(F.col("a"), (kind == "model") & (F.col("a") != "") & ~F.startswith(F.col("a"), F.lit("<"))).alias("model"),
        _first(F.col("ts"), user).alias("first_ts"), _last(F.col("ts"), user).alias("last_ts"),
        F.count_if(user).alias("n_user"), F.count_if(kind == "bad").alias("parse_warnings"), F.coalesce(F.bool_or(kind == "sidechain"), F.lit(False)).alias("sidechain"),
        _first(F.col("turn"), genuine).alias("genuine"),
        _first(T.repo_slug(F.col("said")), command | (output & gitish)).alias("strong"), _first(T.repo_slug(F.col("said")), text | (output & ~gitish)).alias("weak"),
        _first(T.branch_name(F.col("said")), command | output).alias("named"),
        _listed(commit, scanned).alias("commits"),
        _listed(pulls, (command & F.rlike("said", F.lit(P.GIT_OPERATION))) | (output & F.col("git_op"))).alias("prs"),
        _listed(files, (kind == "file") | (command & F.rlike("said", F.lit(P.REMOVE)))).alias("raw_files"),
        _listed(one(F.col("a")), (kind == "skill") & (F.col("a") != "")).alias("skills"), _listed(one(F.col("a")), (kind == "mcp") & (F.col("a") != "")).alias("mcp"),
        _listed(one(F.col("a")), (kind == "subagent") & (F.col("a") != "")).alias("agents"),
        _last(F.col("b"), kind == "todos").alias("todos"),
        _last(T.test_result(F.col("command"), F.col("said")), output & F.col("command").isNotNull() & (F.col("said") != "")).alias("tests"),
        F.array_distinct(_listed(terms, words)).alias("terms"),
        F.coalesce(F.bool_or(F.when(words, F.rlike("said", F.lit(P.GO_TEXT)))), F.lit(False)).alias("go_text"), F.coalesce(F.bool_or(F.when(words, F.rlike("said", F.lit(P.REST_TEXT)))), F.lit(False)).alias("rest_text"),
        F.sort_array(F.collect_list(F.when(is_turn, F.struct("ord", "role", F.col("turn").alias("text"))))).alias("turns"),
        F.sort_array(F.collect_list(F.when(kind == "boundary", F.struct("ord", F.col("a").alias("event"), F.col("b").alias("trigger"))))).alias("marks"),
    )
    s = s.where((F.col("n_user") > 0) & ~F.col("sidechain") & ~F.coalesce(F.rlike("genuine", F.lit(P.POLLUTION)), F.lit(False)))
    return _finish(s)


def _subject(c: Column) -> Column:
    c = T.trim_all(c)
    return F.when(F.char_length(c) > 70, F.concat(F.rtrim(F.substring(c, 1, 70)), F.lit("…"))).otherwise(c)


def _finish(s: DataFrame) -> DataFrame:
    full = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n\n")
    s = s.withColumn("excerpt", T.excerpt_cap(full)).withColumn("turn_count", F.size("turns"))
    last = F.element_at("turns", -1)
    asks = (last["role"] == "ASSISTANT") & F.rlike(last["text"], F.lit(P.PERMISSION))
    tail = F.right(F.col("excerpt"), F.lit(4000))
    resolved = F.when(F.rlike(tail, F.lit(P.OPEN_WORDS)) | asks, "open").when(F.rlike(tail, F.lit(P.DONE_WORDS)), "done").otherwise("unknown")
    root = F.regexp_replace(F.coalesce("cwd", F.lit("")), "/+$", "")
    inside = lambda p: (F.coalesce(F.col("cwd"), F.lit("")) != "") & F.startswith(p, F.concat(root, F.lit("/")))
    shown = F.transform("raw_files", lambda f: F.struct(f["op"].alias("op"), F.when(inside(f["path"]), F.substr(f["path"], F.char_length(root) + 2)).otherwise(f["path"]).alias("path")))
    s = s.withColumn("shown", F.filter(shown, lambda f: f["path"] != ""))
    files = manifest(F.col("shown"))
    counted = F.transform(F.array_distinct("agents"), lambda a: F.struct(a.alias("type"), F.size(F.filter("agents", lambda b: b == a)).alias("count")))
    go = F.col("go_text") | F.exists("raw_files", lambda f: F.endswith(F.lower(f["path"]), F.lit(".go")))
    found = F.concat("terms", F.when(go, F.array(F.lit("go"))).otherwise(F.array().cast("array<string>")), F.when(F.col("rest_text"), F.array(F.lit("rest"))).otherwise(F.array().cast("array<string>")))
    s = s.withColumn("found", found)
    keywords = F.slice(F.filter(F.array(*(F.lit(k) for k in P.KEYWORDS)), lambda k: F.array_contains("found", k)), 1, P.KEYWORD_CAP)
    todo = F.from_json("todos", "array<struct<content:string,status:string>>")
    todos = F.transform(F.filter(todo, lambda t: ~(F.coalesce(t["status"], F.lit("")) == "completed") & (T.trim_all(t["content"]) != "")), lambda t: T.trim_all(t["content"]))
    at = lambda m: F.size(F.filter("turns", lambda t: t["ord"] < m["ord"]))
    marks = F.filter(F.transform("marks", lambda m: F.struct(at(m).alias("turn"), m["event"].alias("event"), m["trigger"].alias("trigger"))), lambda m: m["turn"] > 0)
    tree = F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce("cwd", F.lit("")), p, 1), F.lit("")) for p in P.WORKTREES))
    return s.withColumn("marks", marks).select(
        "sid", F.coalesce("cwd", F.lit("")).alias("cwd"), "model", "first_ts", "last_ts", F.coalesce("strong", "weak").alias("repo"), F.coalesce("named", tree).alias("branch"),
        files.alias("files"), firsts(F.col("commits"), "sha").alias("commits"), F.array_distinct("prs").alias("prs"), keywords.alias("keywords"),
        F.array_distinct("skills").alias("skills"), F.array_distinct("mcp").alias("mcp"), counted.alias("subagents"),
        F.coalesce(todos, F.array().cast("array<string>")).alias("open_todos"), "tests", resolved.alias("resolved"), "excerpt", "turn_count", "turns",
        firsts(F.col("marks"), "turn").alias("boundaries"), "parse_warnings")
