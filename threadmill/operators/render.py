"""Output formats as projections: one line, a block of lines, or a JSON object for each record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions import text as T

PENDING = "(summary pending)"
LABELS = {"asked": "Asked", "learned": "Learned", "completed": "Completed", "left_off": "Left off", "next_steps": "Next steps"}


def compact(date: Column, harness: Column, model: Column, cwd: Column, sid: Column, asked: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    label = F.concat(T.harness_label(harness), F.when(some(model), F.concat(F.lit("("), model, F.lit(")"))).otherwise(""))
    return F.concat_ws("  ", F.when(some(date), date).otherwise("??????????"), label, T.cwd_tail(cwd), T.short_sid(sid), F.when(some(asked), T.truncate(asked, 90)).otherwise(PENDING))


def full() -> Column:
    """The block of a record with the columns of the record schema; lines without content are left out."""
    c = F.col
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    line = lambda cond, *parts: F.when(cond, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    joined = lambda name: F.array_join(c(name), ", ")
    filled = lambda name: F.size(c(name)) > 0
    listed = lambda name, f: line(filled(name), F.array_join(F.transform(c(name), f), "\n"))
    told = F.coalesce(F.greatest(*(F.char_length(c("summary")[k]) for k in LABELS)), F.lit(0)) > 0
    lines = [
        F.concat(F.lit("● "), c("sid")),
        F.concat(F.lit("  "), c("date"), F.lit(" · "), T.harness_label(c("harness")), F.when(some(c("model")), F.concat(F.lit(" ("), c("model"), F.lit(")"))).otherwise(""), F.lit(" · resolved="), F.when(some(c("resolved")), c("resolved")).otherwise("unknown")),
        F.concat(F.lit("  cwd:    "), F.when(some(c("cwd")), c("cwd")).otherwise("-")),
        F.concat(F.lit("  repo:   "), F.when(some(c("repo")), c("repo")).otherwise("-"), F.when(some(c("branch")), F.concat(F.lit(" (branch: "), c("branch"), F.lit(")"))).otherwise("")),
        F.concat(F.lit("  active: "), F.when(some(c("last_active")), c("last_active")).otherwise("-")),
        line(some(c("forked_from")), "  forked_from: ", c("forked_from")),
        F.when(told, F.lit("  summary:")).otherwise(F.concat(F.lit("  summary: (pending — state "), c("summary_state"), F.lit(")"))),
        *(line(some(c("summary")[k]), f"    {label}: ", T.oneline(c("summary")[k])) for k, label in LABELS.items()),
        line(filled("keywords"), "  keywords: ", joined("keywords")), line(filled("skills"), "  skills: ", joined("skills")),
        F.concat(F.lit("  files ("), F.size("files").cast("string"), F.lit("):")), listed("files", lambda f: F.concat(F.lit("    "), f["op"], F.lit(" "), f["path"])),
        F.concat(F.lit("  commits ("), F.size("commits").cast("string"), F.lit("):")), listed("commits", lambda f: F.concat(F.lit("    "), f["sha"], F.lit(" "), f["subject"])),
        line(filled("prs"), "  prs: ", joined("prs")),
        line(filled("subagents"), "  subagents: ", F.array_join(F.transform("subagents", lambda a: F.concat(a["type"], F.lit("×"), a["count"].cast("string"))), ", ")),
        line(filled("mcp"), "  mcp: ", joined("mcp")),
        line(filled("open_todos"), "  open_todos:\n", F.array_join(F.transform("open_todos", lambda t: F.concat(F.lit("    - "), t)), "\n")),
        line(c("tests").isNotNull(), "  tests: ", c("tests")["text"], " (broken=", F.when(c("tests")["broken"], "True").otherwise("False"), ")"),
        F.concat(F.lit("  resume: "), T.resume_string(c("harness"), c("cwd"), c("native_id"))),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def ndjson(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def show(records: DataFrame, excerpts: DataFrame, tail: int = 4000) -> DataFrame:
    """(sid, shown): the block, the end of the transcript, and the line to resume."""
    text = F.when(F.coalesce("excerpt", F.lit("")) != "", F.right("excerpt", F.lit(tail))).otherwise("(transcript not available)")
    shown = F.concat_ws("\n", full(), F.lit("--- transcript tail ---"), text, T.resume_string(F.col("harness"), F.col("cwd"), F.col("native_id")))
    return records.drop("excerpt").join(excerpts.select("sid", "excerpt"), "sid", "left").select("sid", shown.alias("shown"))
