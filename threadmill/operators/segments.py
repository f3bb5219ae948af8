"""Segments: half-open ranges of a session's turns, each with a state, and what follows from them.

A segment is a struct (seq, event, trigger, start, end, bytes, at, state, summary). All functions are expressions over the
array, so cutting, closing and rolling up are projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import text as T
from threadmill.operators.ranking import positions

SEGMENT = ("struct<seq:int,event:string,trigger:string,start:int,end:int,bytes:bigint,at:string,state:string,"
           "summary:struct<asked:string,learned:string,completed:string,left_off:string,next_steps:string>>")
INPUT_CAP, MIN_CHANGE_TURNS, BATCH = 6000, 4, 8


def no_segments() -> Column:
    return F.array().cast(f"array<{SEGMENT}>")


def last_end(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(s, lambda x: x["end"])), F.lit(0))


def last_bytes(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(s, lambda x: x["bytes"])), F.lit(0).cast("long"))


def next_seq(s: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(s, lambda x: x["seq"])), F.lit(0)) + 1


def pending(s: Column) -> Column:
    return F.exists(s, lambda x: x["state"] == "pending")


def segment(seq, event, trigger, start, end, size, at) -> Column:
    none = F.lit(None).cast("struct<asked:string,learned:string,completed:string,left_off:string,next_steps:string>")
    return F.struct(seq.cast("int").alias("seq"), event.alias("event"), trigger.cast("string").alias("trigger"), start.cast("int").alias("start"), end.cast("int").alias("end"),
                    size.cast("long").alias("bytes"), at.cast("string").alias("at"), F.lit("pending").alias("state"), none.alias("summary"))


def append(s: Column, event: Column, turns: Column, size: Column, at: Column, trigger: Column | None = None, force: bool = False, min_turns: int = 0) -> Column:
    """One more cut up to ``turns``. Unforced, none while one is pending or too little is new; forced with nothing new, over everything."""
    start = last_end(s)
    trigger = F.lit(None).cast("string") if trigger is None else trigger
    if force:
        start = F.when(start >= turns, 0).otherwise(start)
        cut = start < turns
    else:
        cut = ~pending(s) & (start < turns) & (turns - start >= min_turns)
    return F.when(cut, F.concat(s, F.array(segment(next_seq(s), event, trigger, start, turns, size, at)))).otherwise(s)


def replay(s: Column, boundaries: Column, turns: Column, size: Column, at: Column) -> Column:
    """Forced cuts at the boundaries beyond the last end and not beyond the last turn, in order."""
    start = s.cast(f"array<{SEGMENT}>")
    return F.aggregate(boundaries, start, lambda acc, b: F.when(
        (b["turn"] > last_end(acc)) & (b["turn"] <= turns),
        F.concat(acc, F.array(segment(next_seq(acc), F.coalesce(b["event"], F.lit("precompact")), b["trigger"], last_end(acc), b["turn"], size, at))).cast(f"array<{SEGMENT}>")).otherwise(acc))


def cut(s: Column, boundaries: Column, turns: Column, size: Column, at: Column, event: Column, trigger: Column) -> Column:
    """What an upsert opens: cuts the log itself carries, then the hook's cut, or the tail, or growth of four turns."""
    replayed = replay(s, boundaries, turns, size, at)
    grew = F.size(replayed) > F.size(s)
    return (
        F.when(event.isNotNull(), append(replayed, event, turns, size, at, trigger, force=True))
        .when(grew, append(replayed, F.lit("change"), turns, size, at, force=True))
        .when((F.size(s) > 0) & (size > last_bytes(s)), append(s, F.lit("change"), turns, size, at, min_turns=MIN_CHANGE_TURNS)).otherwise(replayed))


def backfill(s: Column, turns: Column, size: Column, at: Column) -> Column:
    """One cut over everything for a record without segments."""
    return F.when(F.size(s) == 0, append(s, F.lit("backfill"), turns, size, at)).otherwise(s)


def close(s: Column, seq: Column, summary: Column | None) -> Column:
    """A pending segment becomes done with the summary's five fields, or an error where there is none."""
    fields = F.struct(*(F.coalesce(summary[k], F.lit("")).alias(k) for k in P.SUMMARY_FIELDS)) if summary is not None else None
    state = "done" if summary is not None else "error"
    names = ["seq", "event", "trigger", "start", "end", "bytes", "at"]
    return F.transform(s, lambda x: F.when((x["seq"] == seq) & (x["state"] == "pending"), F.struct(
        *(x[n].alias(n) for n in names), F.lit(state).alias("state"), (fields if fields is not None else x["summary"]).alias("summary"))).otherwise(x))


def rollup(s: Column, state: Column) -> Column:
    """The record's summary state from its segments' states; without segments the one it has."""
    has = lambda v: F.exists(s, lambda x: x["state"] == v)
    return (F.when(F.size(F.coalesce(s, no_segments())) == 0, state).when(has("pending") & has("done"), F.lit("partial")).when(has("pending"), F.lit("pending"))
            .when(has("done"), F.lit("done")).when(has("error"), F.lit("error")).otherwise(F.lit("pending")))


def split_turns(excerpt: Column) -> Column:
    """Turns of an imported excerpt, found by their role prefix at a line's start."""
    parts = F.filter(F.transform(F.split(excerpt, r"(?m)^(?=(?:USER|ASSISTANT): )"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: T.trim_all(p) != "")
    blank = F.coalesce(T.trim_all(excerpt), F.lit("")) == ""
    return F.when(blank, F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(T.trim_all(excerpt))).otherwise(parts)


def slice_turns(turns: Column, start: Column, end: Column) -> Column:
    lo = F.greatest(F.least(start, F.size(turns)), F.lit(0))
    hi = F.greatest(F.least(end, F.size(turns)), lo)
    return F.array_join(F.slice(turns, lo + 1, hi - lo), "\n\n")


def boundary_ranges(boundaries: DataFrame, ends: DataFrame) -> DataFrame:
    """(sid, start, end, event) of the cuts at ``boundaries`` (sid, turn, event), given ``ends`` (sid, last_end, turn_count): the same as replay, by window."""
    b = boundaries.join(ends, "sid").where((F.col("turn") > F.col("last_end")) & (F.col("turn") <= F.col("turn_count")))
    b = b.groupBy("sid", "turn", "last_end").agg(F.min("event").alias("event"))
    w = Window.partitionBy("sid").orderBy("turn")
    return b.select("sid", F.coalesce(F.lag("turn").over(w), "last_end").alias("start"), F.col("turn").alias("end"), "event")


def work(records: DataFrame) -> DataFrame:
    """(sid, seq, text) to summarize: pending segments first, then records without segments that lack a summary and have a text."""
    todo = records.select("sid", "turns", F.explode(F.filter("segments", lambda x: x["state"] == "pending")).alias("s"))
    todo = todo.select("sid", F.col("s.seq").alias("seq"), T.cap_text(slice_turns(F.col("turns"), F.col("s.start"), F.col("s.end")), INPUT_CAP).alias("text"), F.lit(0).alias("tier"))
    whole = records.where((F.size("segments") == 0) & F.col("summary_state").isin("pending", "stale", "error", "partial") & (T.trim_all(F.col("excerpt")) != ""))
    whole = whole.select("sid", F.lit(0).alias("seq"), T.cap_text(F.col("excerpt"), INPUT_CAP).alias("text"), F.lit(1).alias("tier"))
    return todo.unionByName(whole).orderBy("tier", "sid", "seq")


def batches(items: DataFrame, size: int = BATCH) -> DataFrame:
    """``items`` (sid, seq, ...) with the number of their batch of ``size`` in the order of sid and seq."""
    return positions(items, "sid", False, "seq").withColumn("batch", F.floor((F.col("position") - 1) / size).cast("long"))


def assign(items: DataFrame, prefer: str, available: list[str]) -> DataFrame:
    """``items`` with ``by``, the summarizer of each: the preferred one ("same": of the session's own family), then the session's own, then
    any; items that no available one can take are left out, for a machine that has one."""
    own = F.split_part("sid", F.lit("/"), F.lit(1))
    order = [own if prefer == "same" else F.lit(prefer), own, *map(F.lit, available)]
    return items.withColumn("by", F.coalesce(*(F.when(x.isin(available), x) for x in order))).where("by is not null") if available else items.withColumn("by", F.lit(None).cast("string")).limit(0)


def summarize(work_items: DataFrame, summarizer) -> DataFrame:
    """(sid, seq, answer): segments of a session in order, each given the answer before it. ``summarizer(text, previous) -> str``, or
    several of them by the name in the column ``by``.

    A session's segments are serial by nature; sessions run side by side.
    """
    several = isinstance(summarizer, dict)

    def run(part):
        part = part.sort_values("seq")
        previous, out = "", []
        for row in part.itertuples():
            previous = (summarizer[row.by] if several else summarizer)(row.text, previous) or previous
            out.append(previous)
        return part[["sid", "seq"]].assign(answer=out)

    items = work_items.select("sid", "seq", "text", *(["by"] if several else []))
    return items.groupBy("sid").applyInPandas(run, "sid string, seq int, answer string")


_LABELS = "\n".join(f"- **{x}:** ..." for x in ("Asked", "Learned", "Completed", "Left off", "Next steps", "Resolved"))
_OPENING = f"@@THREADMILL-SUMMARIZER@@\nAnswer for each marker with exactly these lines:\n{_LABELS}\n\n"


def contract(previous: str, event: str) -> str:
    """What stands before the turns in a summarizer's request."""
    return _OPENING + (f"So far:\n{previous}\n\n" if previous else "") + f"New turns ({event}):\n"


def prompt(text: Column, previous: Column, event: Column) -> Column:
    """What a summarizer is asked: the contract, what is known so far, and the new turns."""
    known = F.when(F.coalesce(previous, F.lit("")) != "", F.concat(F.lit("So far:\n"), previous, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit(_OPENING), known, F.lit("New turns ("), event, F.lit("):\n"), text)
