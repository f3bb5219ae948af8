"""Scalar column functions on session fields and free text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip_private(c: Column) -> Column:
    """Closed private spans, in any case and over lines, become a placeholder; an unclosed tag stays."""
    return F.regexp_replace(c, r"(?is)<private>.*?</private>", F.lit(re.sub(r"([\[\]$])", r"\\\1", P.PRIVATE)))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def oneline(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def truncate(c: Column, n: int) -> Column:
    one = oneline(F.coalesce(c, F.lit("")))
    return F.when(F.char_length(one) <= n, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, n)), F.lit("…")))


def cap_text(c: Column, cap: int = 6000) -> Column:
    """Middle-trimmed to about ``cap`` characters."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.char_length(c) <= cap, c).otherwise(F.concat(F.substring(c, 1, cap * 2 // 3), F.lit(P.TRIMMED), F.right(c, F.lit(cap // 3))))


def excerpt_cap(c: Column) -> Column:
    return F.when(F.char_length(c) <= P.EXCERPT_LIMIT, c).otherwise(
        F.concat(F.substring(c, 1, P.EXCERPT_HEAD), F.lit(P.TRIMMED), F.right(c, F.lit(P.EXCERPT_TAIL))))


def cwd_tail(c: Column, n: int = 2) -> Column:
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.lit("?")).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/"))


def harness_label(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("?")).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))))


def make_sid(harness: Column, uuid: Column) -> Column:
    return F.concat(harness, F.lit("/"), uuid)


def sid_valid(sid: Column) -> Column:
    return F.coalesce(F.rlike(sid, F.lit(r"(?s)^[^/]+/.+")), F.lit(False))


def sid_uuid(sid: Column) -> Column:
    return F.regexp_replace(sid, r"^[^/]*/", "")


def short_sid(sid: Column, width: int = 8) -> Column:
    return F.concat(F.split_part(sid, F.lit("/"), F.lit(1)), F.lit("/"), F.substring(sid_uuid(sid), 1, width))


def shell_quote(c: Column) -> Column:
    """POSIX quoting of one word."""
    safe = F.rlike(c, F.lit(r"^[A-Za-z0-9_@%+=:,./-]+$"))
    return F.when(safe, c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


def resume_string(harness: Column, cwd: Column, native: Column) -> Column:
    where = shell_quote(F.when(F.coalesce(cwd, F.lit("")) == "", F.lit(".")).otherwise(cwd))
    what = shell_quote(F.coalesce(native, F.lit("")))
    return F.concat(F.lit("cd "), where, F.when(harness == "codex", F.lit(" && codex resume ")).otherwise(F.lit(" && claude --resume ")), what)


def parse_ts(c: Column) -> Column:
    return F.try_to_timestamp(c)


def decay(date: Column, today: str, half_life: int = 90) -> Column:
    """Half-life decay of a date string, rounded to 12 digits; the future and what is no date count as today."""
    age = F.greatest(F.coalesce(F.datediff(F.lit(today).cast("date"), F.try_to_date(date, "yyyy-MM-dd")), F.lit(0)), F.lit(0))
    return F.round(F.pow(F.lit(0.5), age / F.lit(float(half_life))), 12)


def ordered_union(base: Column, extra: Column) -> Column:
    return F.concat(base, F.array_except(extra, base))


def glob_regex(glob: str) -> str:
    """Shell glob as an anchored pattern: ``*`` also crosses separators, ``[!x]`` negates."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[0] in "!" else body.replace("^", "\\^")) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^(?:{out})$"


def any_glob(c: Column, globs: list[str]) -> Column:
    hits = [F.rlike(c, F.lit(glob_regex(g))) for g in globs if g]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)) if hits else F.lit(False)


def cwd_excluded(cwd: Column, globs: list[str]) -> Column:
    """Whether the folder, or the folder with one trailing slash, matches a glob."""
    some = F.coalesce(cwd, F.lit("")) != ""
    return some & (any_glob(cwd, globs) | any_glob(F.concat(F.regexp_replace(cwd, "/+$", ""), F.lit("/")), globs))


def path_globs(globs: list[str]) -> list[str]:
    """Globs for path fragments: a leading ``**/`` also matches where the separator was flattened."""
    return [v for g in globs if g for v in ([g, "**" + g[3:]] if g.startswith("**/") else [g])]


def path_excluded(path: Column, globs: list[str]) -> Column:
    return (F.coalesce(path, F.lit("")) != "") & any_glob(path, path_globs(globs))


def scrub_files(files: Column, globs: list[str]) -> Column:
    """Manifest entries (op, path) under an excluded path become the marker."""
    done = F.struct(F.lit("scrubbed").alias("op"), F.lit(P.EXCLUDED).alias("path"))
    return F.transform(files, lambda f: F.when((f["op"] == "scrubbed") | (f["path"] == P.EXCLUDED) | path_excluded(f["path"], globs), done).otherwise(F.struct(f["op"].alias("op"), f["path"].alias("path"))))


def n_scrubbed(files: Column, globs: list[str]) -> Column:
    return F.size(F.filter(files, lambda f: (f["op"] != "scrubbed") & (f["path"] != P.EXCLUDED) & path_excluded(f["path"], globs)))


def _tokens(text: Column) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(P.PATH_TOKEN), F.lit(0)), F.split(text, P.PATH_TOKEN, -1)


def scrub_text(text: Column, globs: list[str]) -> Column:
    """Path-shaped tokens under an excluded path become the marker; the text is cut at its tokens and glued again. What holds no
    separator holds no path."""
    tokens, gaps = _tokens(text)
    said = F.transform(tokens, lambda t: F.when(path_excluded(t, globs), F.lit(P.EXCLUDED)).otherwise(t))
    return F.when(F.contains(text, F.lit("/")), F.array_join(F.zip_with(gaps, said, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")).otherwise(text)


def n_scrubbed_text(text: Column, globs: list[str]) -> Column:
    return F.size(F.filter(_tokens(text)[0], lambda t: path_excluded(t, globs)))


def mcp_label(name: Column) -> Column:
    server = F.split_part(F.regexp_replace(name, "^mcp__", ""), F.lit("__"), F.lit(1))
    inner = F.regexp_replace(server, "^plugin_", "")
    return F.when(F.startswith(server, F.lit("plugin_")), F.regexp_replace(inner, "^[^_]*_", "")).otherwise(server)


def rm_paths(command: Column) -> Column:
    """Paths that rm or git rm removes, as far as the words tell."""
    parts = F.transform(F.split(command, r"&&|\|\||;|\|"), trim_all)
    removes = F.filter(parts, lambda s: F.rlike(s, F.lit(r"^(?:git\s+)?rm\b")))
    words = F.flatten(F.transform(removes, lambda s: F.split(trim_all(F.regexp_replace(s, r"^(?:git\s+)?rm\b", "")), r"\s+")))
    plain = F.filter(words, lambda w: ~F.startswith(w, F.lit("-")) & ~F.rlike(w, F.lit(r"[$*`<>{}()]")))
    return F.filter(F.transform(plain, lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", "")), lambda w: w != "")


def test_result(command: Column, output: Column) -> Column:
    """(text, broken) of a test or build run; null where the command is none."""
    number = lambda p: F.coalesce(F.regexp_extract(output, p, 1).try_cast("int"), F.lit(0))
    fails, passes = number(P.TEST_FAILED), number(P.TEST_PASSED)
    bad, good = F.rlike(output, F.lit(P.FAIL_WORDS)), F.rlike(output, F.lit(P.OK_WORDS))
    broken = (fails > 0) | (bad & (passes == 0) & ~good)
    text = (
        F.when((fails > 0) & (passes > 0), F.concat(passes.cast("string"), F.lit(" passed, "), fails.cast("string"), F.lit(" failed")))
        .when(fails > 0, F.concat(fails.cast("string"), F.lit(" failed"))).when(passes > 0, F.concat(passes.cast("string"), F.lit(" passed")))
        .when(broken, F.lit("failed")).when(good, F.lit("passed")).otherwise(F.lit("ran")))
    silent = F.coalesce(output, F.lit("")) == ""
    found = F.when(silent, F.struct(F.lit("ran, no output").alias("text"), F.lit(False).alias("broken"))).otherwise(F.struct(text.alias("text"), broken.alias("broken")))
    return F.when(F.rlike(F.coalesce(command, F.lit("")), F.lit(P.TEST_COMMAND)), found)


def repo_slug(text: Column) -> Column:
    owner, name = F.regexp_extract(text, P.REPOSITORY, 1), F.regexp_replace(F.regexp_extract(text, P.REPOSITORY, 2), "[.-]+$", "")
    return F.when((owner != "") & (name != "") & ~name.isin("pull", "tree", "blob"), F.concat(owner, F.lit("/"), name))


def branch_name(text: Column) -> Column:
    """First accepted hit of the ordered patterns."""
    hits = [F.regexp_extract(text, p, 1) for p in P.BRANCHES]
    return F.coalesce(*(F.when(~h.isin("", *P.BRANCH_REJECTS) & F.rlike(h, F.lit(r"[\p{L}\p{N}]")), h) for h in hits))


def summary_fields(body: Column) -> Column:
    """The labelled lines of a summarizer's answer as a struct with ``resolved``; null if all five are empty."""
    labels = {"asked": "Asked", "learned": "Learned", "completed": "Completed", "left_off": "Left off", "next_steps": "Next steps", "resolved": "Resolved"}
    get = lambda label: trim_all(F.regexp_extract(body, rf"(?im)^[ \t]*-\s*\*\*{label}:\*\*\s*(\S.*)$", 1))
    found = {k: get(v) for k, v in labels.items()}
    state = F.lower(found.pop("resolved"))
    some = reduce(lambda a, b: a | b, ((v != "") for v in found.values()))
    return F.when(some, F.struct(*(v.alias(k) for k, v in found.items()), F.when(state.isin("open", "done", "unknown"), state).alias("resolved")))


def rollout_uuid(name: Column) -> Column:
    """Last five dash groups of a rollout's name, or all of it."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.jsonl$", ""), "^rollout-", "")
    parts = F.split(stem, "-")
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, -5, 5), "-")).otherwise(stem)
