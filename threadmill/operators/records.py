"""Records as a whole: their schema, checks, and what is read from older files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import text as T
from threadmill.operators.segments import SEGMENT

SUMMARY = "struct<" + ",".join(f"{k}:string" for k in P.SUMMARY_FIELDS) + ">"
#: Columns of a stored record with their types and what they are where nothing is known.
SCHEMA = {
    "sid": "string", "harness": "string", "native_id": "string", "date": "string", "cwd": "string", "last_active": "string", "indexed_at": "string", "model": "string", "repo": "string",
    "branch": "string", "forked_from": "string", "files": "array<struct<op:string,path:string>>", "commits": "array<struct<sha:string,subject:string>>", "prs": "array<string>",
    "keywords": "array<string>", "skills": "array<string>", "subagents": "array<struct<type:string,count:int>>", "mcp": "array<string>", "open_todos": "array<string>",
    "tests": "struct<text:string,broken:boolean>", "resolved": "string", "summary": SUMMARY, "summary_state": "string", "transcript_path": "string", "client": "string",
    "parse_warnings": "bigint", "segments": f"array<{SEGMENT}>", "excerpt": "string", "turns": "array<string>", "turn_count": "int", "boundaries": "array<struct<turn:int,event:string,trigger:string>>", "size": "bigint",
}
RESOLVED, STATES, SEGMENT_STATES = ["open", "done", "unknown"], ["pending", "stale", "done", "error", "partial"], ["pending", "done", "error"]


def empty_summary() -> Column:
    return F.struct(*(F.lit("").alias(k) for k in P.SUMMARY_FIELDS))


def conform(df: DataFrame) -> DataFrame:
    """``df`` with exactly the record's columns; what is missing is null, empty or pending."""
    def value(name: str, kind: str) -> Column:
        if name in df.columns:
            c = F.col(name)
        elif name == "summary":
            c = empty_summary()
        else:
            c = F.lit({"summary_state": "pending"}.get(name))
        c = c.cast(kind) if kind != SUMMARY else c
        return (F.coalesce(c, F.array().cast(kind)) if kind.startswith("array") else c).alias(name)

    return df.select(*(value(n, k) for n, k in SCHEMA.items()))


#: Constraints on a record's fields and on its segments' fields: what must be there, and what an enumeration allows.
NEEDED, SEGMENT_NEEDED = ["sid", "harness", "date", "summary"], ["seq", "start", "end", "bytes"]
ALLOWED = {"harness": ["claude", "codex"], "resolved": RESOLVED, "summary_state": STATES}
SEGMENT_ALLOWED = {"event": P.SEGMENT_EVENTS, "state": SEGMENT_STATES}


def broken(value, needed: list[str], allowed: dict[str, list[str]], relations: dict[str, tuple[str, Column]], prefix: Column) -> Column:
    """(field, rule) of the constraints that ``value(field)`` doesn't keep; a relation is broken where it is false, not where it is null."""
    blank = lambda f: value(f).isNull() if f == "summary" else F.coalesce(value(f).cast("string"), F.lit("")) == ""
    rules = [(f, "needed", ~blank(f)) for f in needed]
    rules += [(f, "one of " + ", ".join(options), F.coalesce(value(f).isin(options), F.lit(False))) for f, options in allowed.items()]
    rules += [(f, text, F.coalesce(holds, F.lit(True))) for f, (text, holds) in relations.items()]
    return F.array_compact(F.array(*(F.when(~holds, F.struct(F.concat(prefix, F.lit(f)).alias("field"), F.lit(text).alias("rule"))) for f, text, holds in rules)))


def problems() -> Column:
    """The constraints that a record breaks, as (field, rule); empty where it is valid."""
    c = F.col
    of = F.split_part(c("sid"), F.lit("/"), F.lit(1))
    outer = broken(c, NEEDED, ALLOWED, {"sid": ("harness/id of its own harness", T.sid_valid(c("sid")) & of.eqNullSafe(c("harness")))}, F.lit(""))
    inner = F.transform(c("segments"), lambda s, i: broken(lambda f: s[f], SEGMENT_NEEDED, SEGMENT_ALLOWED, {"end": ("not before start", s["end"] >= s["start"])}, F.format_string("segments[%d].", i)))
    return F.concat(outer, F.coalesce(F.flatten(inner), F.array().cast("array<struct<field:string,rule:string>>")))


def has_summary(summary: Column) -> Column:
    return F.coalesce(F.greatest(*(F.char_length(summary[k]) for k in P.SUMMARY_FIELDS)), F.lit(0)) > 0


def fts_columns() -> list[Column]:
    """The twelve texts of the word index; a phrase lies inside one of them."""
    c = F.col
    joined = lambda x: F.array_join(x, " ")
    texts = {
        **{k: c("summary")[k] for k in P.SUMMARY_FIELDS}, "keywords": joined(c("keywords")), "cwd": c("cwd"), "repo": c("repo"), "branch": c("branch"),
        "commits": joined(F.transform("commits", lambda x: x["subject"])), "files": joined(F.transform("files", lambda x: x["path"])), "skills": joined(c("skills"))}
    return [F.coalesce(t, F.lit("")).alias(n) for n, t in texts.items()]


def search_text() -> list[Column]:
    """The texts a record is searched by: the index's twelve columns and the rest of the haystack."""
    c = F.col
    joined = lambda x: F.array_join(x, " ")
    return [*fts_columns(), joined(F.transform("subagents", lambda x: x["type"])), joined(c("mcp")), joined(c("open_todos")), c("model"), c("native_id")]


def sidecar_body(text: Column) -> Column:
    """An old excerpt file without its header; '' for none."""
    at = F.instr(text, "\n---\n\n")
    return F.coalesce(F.when(at > 0, F.substr(text, at + 6)).otherwise(text), F.lit(""))


def upgrade_watermarks(old: DataFrame, key: Column) -> DataFrame:
    """Watermarks by path as watermarks by identity: of several paths the latest counts."""
    return old.select(key.alias("key"), "mtime", "size").groupBy("key").agg(F.max_by(F.struct("mtime", "size"), "mtime").alias("m")).select("key", "m.mtime", "m.size")


def roots(folder: str, enabled: bool = True, siblings: tuple[str, ...] = ()) -> list[str]:
    """The folders of a source that exist: itself and siblings such as an archive."""
    if not enabled:
        return []
    found = [folder, *(os.path.join(os.path.dirname(folder.rstrip("/")), s) for s in siblings)]
    return [f for f in found if os.path.isdir(f)]


def apply_answers(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Records with the summarizer's answers (sid, seq, answer): seq 0 is the whole record, others close their pending segment. A later segment's
    summary is the record's; an answer without any of the five fields is an error."""
    a = answers.select("sid", F.struct("seq", T.summary_fields(F.col("answer")).alias("f")).alias("x")).groupBy("sid").agg(F.sort_array(F.collect_list("x")).alias("_a"))
    d = records.join(a, "sid", "left")
    mine = lambda s: F.get(F.filter("_a", lambda x: x["seq"] == s["seq"]), F.lit(0))
    five = lambda f: F.struct(*(F.coalesce(f[k], F.lit("")).alias(k) for k in P.SUMMARY_FIELDS))
    segs = F.transform("segments", lambda s: F.when((s["state"] == "pending") & mine(s).isNotNull(), s.withField("state", F.when(mine(s)["f"].isNull(), "error").otherwise("done")).withField(
        "summary", F.when(mine(s)["f"].isNull(), s["summary"]).otherwise(five(mine(s)["f"])))).otherwise(s))
    last = F.try_element_at(F.filter("_a", lambda x: x["f"].isNotNull()), F.lit(-1))
    from threadmill.operators.segments import rollup

    whole = F.when(F.col("_a").isNull(), F.col("summary_state")).when(last.isNull(), "error").otherwise("done")
    good = F.col("_a").isNotNull() & last.isNotNull()
    d = d.withColumn("_s", F.when(F.col("_a").isNull(), F.col("segments")).otherwise(segs)).withColumn("_last", F.when(good, last["f"]))
    state = F.when(F.size("_s") > 0, rollup(F.col("_s"), F.col("summary_state"))).otherwise(whole)
    return d.withColumn("segments", F.col("_s")).withColumn("summary_state", state).withColumn("summary", F.when(F.col("_last").isNotNull(), five(F.col("_last"))).otherwise(F.col("summary"))).withColumn(
        "resolved", F.coalesce(F.col("_last")["resolved"], F.col("resolved"))).drop("_a", "_s", "_last")
