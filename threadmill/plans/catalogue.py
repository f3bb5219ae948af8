"""Every named query and, where SQL can say the same, its DuckDB text.

Array results are joined to strings and floats rounded, so that results compare by value. ``today`` is a fixed day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions import patterns as P
from threadmill.functions import text as T
from threadmill.operators import fold, render, search, segments, store
from threadmill.plans.lens import lens, with_lenses
from threadmill.plans.transcripts import written
from threadmill.sources import logs

TODAY = "2024-06-30"
GLOBS = ["**/private-notes/**"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_lenses(sql)
        return f

    return add


def long(c, name: str):
    return F.col(c).cast("long").alias(name) if isinstance(c, str) else c.cast("long").alias(name)


def log_sessions(spark: SparkSession, d: str) -> DataFrame:
    return fold.sessions(lens(spark, d, "log"))


# --- SQL pieces the oracles share ---------------------------------------------------------------------------------

_SAID = "trim(regexp_replace(CASE WHEN kind = 'command' THEN a ELSE b END, '<private>.*?</private>', '[private]', 'gis'))"
_EV = f"ev AS (SELECT *, {_SAID} AS said FROM @log)"
_TURN = "tn AS (SELECT * FROM ev WHERE kind = 'turn' AND said <> '' AND (role = 'ASSISTANT' OR NOT starts_with(said, '<')))"
_LIVE = "live AS (SELECT DISTINCT sid FROM tn WHERE role = 'USER')"
_CMD = """cm AS (SELECT *, last_value(CASE WHEN kind = 'command' THEN said END IGNORE NULLS) OVER (PARTITION BY sid, call_id ORDER BY ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS command FROM ev WHERE call_id IS NOT NULL)"""
_LOG = f"WITH {_EV}, {_TURN}, {_LIVE}"


# --- turns and excerpts -------------------------------------------------------------------------------------------

@query("""WITH t AS (SELECT conv_id, string_agg(concat(upper(role), ': ', trim(text)), chr(10) || chr(10) ORDER BY ord) AS e, count(*) AS turn_count
  FROM @turns WHERE trim(text) <> '' GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0)
  SELECT conv_id, turn_count, CASE WHEN length(e) <= 36000 THEN e ELSE e[1:24000] || chr(10) || '...[trimmed]...' || chr(10) || right(e, 12000) END AS excerpt FROM t""")
def excerpt_build(spark, d):
    t = lens(spark, d, "turns").withColumn("text", T.trim_all(T.strip_private(F.col("text")))).where("text <> ''")
    e = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ord", "role", "text"))).alias("t"), F.count_if(F.col("role") == "user").alias("u")).where("u > 0")
    full = F.array_join(F.transform("t", lambda x: F.concat(F.upper(x["role"]), F.lit(": "), x["text"])), "\n\n")
    return e.select("conv_id", long(F.size("t"), "turn_count"), T.excerpt_cap(full).alias("excerpt"))


@query(f"{_LOG} SELECT sid, ord, role, said AS text FROM tn")
def turn_gate(spark, d):
    e = fold.with_turns(fold.with_commands(lens(spark, d, "log")))
    return e.where("turn is not null").select("sid", "ord", "role", F.col("turn").alias("text"))


@query("""WITH c AS (SELECT conv_id, ord, role, text, CASE WHEN x = 0 THEN 'event' ELSE 'item' END AS channel, ord * 2 + x AS o FROM @turns, (SELECT 0 AS x UNION ALL SELECT 1) z WHERE x = 0 OR ord % 2 = 0),
  k AS (SELECT *, first_value(channel) OVER (PARTITION BY conv_id, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY o) AS f FROM c) SELECT conv_id, ord, role, channel FROM k WHERE channel = f""")
def turn_dedup(spark, d):
    t = lens(spark, d, "turns")
    both = t.withColumn("x", F.explode(F.when(F.col("ord") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = both.select(F.col("conv_id").alias("sid"), (F.col("ord") * 2 + F.col("x")).alias("ord"), "role", F.col("text").alias("b"), F.when(F.col("x") == 0, "event").otherwise("item").alias("channel"), F.col("ord").alias("at"))
    return fold.dedupe_channels(both).select(F.col("sid").alias("conv_id"), F.col("at").alias("ord"), "role", "channel")


@query(f"{_LOG} SELECT sid, arg_min(ts, ord) AS first_ts, arg_max(ts, ord) AS last_ts FROM tn WHERE role = 'USER' GROUP BY sid")
def first_last_ts(spark, d):
    return log_sessions(spark, d).select("sid", "first_ts", "last_ts")


@query(f"{_LOG} SELECT sid, arg_max(a, ord) FILTER (kind = 'model' AND a <> '' AND NOT starts_with(a, '<')) AS model, coalesce(arg_min(a, ord) FILTER (kind = 'cwd' AND a <> ''), '') AS cwd FROM ev SEMI JOIN live USING (sid) GROUP BY sid")
def model_cwd(spark, d):
    return log_sessions(spark, d).select("sid", "model", "cwd")


@query(f"""{_LOG}, x AS (SELECT sid, ord, regexp_extract(said, '\\[[\\w./-]+\\s+([0-9a-f]{{7,40}})\\]\\s+([^\\n]+)', 1) AS sha, trim(regexp_extract(said, '\\[[\\w./-]+\\s+([0-9a-f]{{7,40}})\\]\\s+([^\\n]+)', 2)) AS s
  FROM ev SEMI JOIN live USING (sid) WHERE kind = 'output') SELECT sid, sha, CASE WHEN length(arg_min(s, ord)) > 70 THEN rtrim(arg_min(s, ord)[1:70]) || '…' ELSE arg_min(s, ord) END AS subject FROM x WHERE sha <> '' GROUP BY sid, sha""")
def commits_extract(spark, d):
    return log_sessions(spark, d).select("sid", F.inline("commits"))


@query(f"""{_LOG}, g AS (SELECT *, max(CASE WHEN kind = 'command' AND regexp_matches(said, 'git push|gh pr (create|merge)') THEN 1 ELSE 0 END) OVER (PARTITION BY sid, call_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op
  FROM ev WHERE call_id IS NOT NULL), x AS (SELECT sid, ord, regexp_extract(said, 'https://github\\.com/[\\w.-]+/[\\w.-]+/pull/[0-9]+') AS url FROM g SEMI JOIN live USING (sid) WHERE kind = 'output' AND op = 1)
  SELECT sid, url FROM x WHERE url <> '' GROUP BY sid, url""")
def prs_extract(spark, d):
    return log_sessions(spark, d).select("sid", F.explode("prs").alias("url"))


@query(f"""{_LOG}, x AS (SELECT sid, ord, regexp_extract(said, 'github\\.com[:/]([\\w.-]+/\\w[\\w-]*)', 1) AS slug FROM ev SEMI JOIN live USING (sid) WHERE kind IN ('output', 'command'))
  SELECT l.sid, arg_min(slug, ord) FILTER (slug <> '') AS repo FROM live l LEFT JOIN x USING (sid) GROUP BY l.sid""")
def repo_pick(spark, d):
    return log_sessions(spark, d).select("sid", "repo")


@query(f"""{_LOG}, x AS (SELECT sid, ord, coalesce(nullif(regexp_extract(said, 'git\\s+push\\s+\\S+\\s+([\\w./][\\w./-]*)', 1), ''), nullif(regexp_extract(said, 'On branch\\s+([\\w./][\\w./-]*)', 1), '')) AS b
  FROM ev SEMI JOIN live USING (sid) WHERE kind IN ('command', 'output')) SELECT l.sid, arg_min(b, ord) FILTER (b IS NOT NULL) AS branch FROM live l LEFT JOIN x USING (sid) GROUP BY l.sid""")
def branch_pick(spark, d):
    return log_sessions(spark, d).select("sid", "branch")


@query(f"WITH {_EV}, {_CMD} SELECT sid, ord, call_id, command FROM cm WHERE kind = 'output'")
def output_asof_command(spark, d):
    return fold.with_commands(lens(spark, d, "log")).where("kind = 'output'").select("sid", "ord", "call_id", "command")


@query("""WITH c AS (SELECT sid, ord, trim(unnest(regexp_split_to_array(a, '&&|\\|\\||;|\\|'))) AS s FROM @log WHERE kind = 'command'),
  w AS (SELECT sid, ord, unnest(regexp_split_to_array(trim(regexp_replace(s, '^(git\\s+)?rm\\b', '')), '\\s+')) AS p FROM c WHERE regexp_matches(s, '^(git\\s+)?rm\\b'))
  SELECT sid, ord, trim(p, '''"') AS path FROM w WHERE NOT starts_with(p, '-') AND NOT regexp_matches(p, '[$*`<>{}()]') AND trim(p, '''"') <> ''""")
def rm_paths(spark, d):
    return lens(spark, d, "log").where("kind = 'command'").select("sid", "ord", F.explode(T.rm_paths(F.col("a"))).alias("path"))


@query(f"""{_LOG}, cwd AS (SELECT sid, coalesce(arg_min(a, ord) FILTER (kind = 'cwd' AND a <> ''), '') AS c FROM @log GROUP BY sid),
  cs AS (SELECT sid, ord, trim(unnest(regexp_split_to_array(said, '&&|\\|\\||;|\\|'))) AS s FROM ev WHERE kind = 'command'),
  w AS (SELECT sid, ord, unnest(regexp_split_to_array(trim(regexp_replace(s, '^(git\\s+)?rm\\b', '')), '\\s+')) AS p FROM cs WHERE regexp_matches(s, '^(git\\s+)?rm\\b')),
  r AS (SELECT sid, 'D' AS op, trim(p, '''"') AS path FROM w WHERE NOT starts_with(p, '-') AND NOT regexp_matches(p, '[$*`<>{{}}()]') UNION ALL SELECT sid, a, b FROM ev WHERE kind = 'file'),
  s AS (SELECT sid, op, CASE WHEN c <> '' AND starts_with(path, c || '/') THEN path[length(c) + 2:] ELSE path END AS path FROM r JOIN cwd USING (sid) SEMI JOIN live USING (sid))
  SELECT sid, path, CASE max(CASE op WHEN 'C' THEN 3 WHEN 'M' THEN 2 ELSE 1 END) WHEN 3 THEN 'C' WHEN 2 THEN 'M' ELSE 'D' END AS op FROM s WHERE path <> '' GROUP BY sid, path""")
def files_manifest(spark, d):
    return log_sessions(spark, d).select("sid", F.inline("files"))


@query(f"{_LOG} SELECT sid, a AS type, count(*) AS n FROM ev SEMI JOIN live USING (sid) WHERE kind = 'subagent' GROUP BY sid, a")
def subagent_counts(spark, d):
    return log_sessions(spark, d).select("sid", F.inline("subagents")).select("sid", "type", long("count", "n"))


@query(f"""{_LOG}, x AS (SELECT sid, a, min(ord) AS o FROM ev SEMI JOIN live USING (sid) WHERE kind = 'skill' GROUP BY sid, a)
  SELECT l.sid, coalesce(string_agg(a, ',' ORDER BY o), '') AS skills FROM live l LEFT JOIN x USING (sid) GROUP BY l.sid""")
def ordered_distinct(spark, d):
    return log_sessions(spark, d).select("sid", F.array_join("skills", ",").alias("skills"))


@query(f"""{_LOG}, x AS (SELECT sid, arg_max(ord, ord) AS o FROM ev WHERE kind = 'todos' GROUP BY sid)
  SELECT l.sid, CASE WHEN o IS NULL THEN '' WHEN o % 2 = 0 THEN 'last' ELSE concat('step ', CAST(o % 4 AS STRING), '|last') END AS todos FROM live l LEFT JOIN x USING (sid)""")
def last_todos(spark, d):
    return log_sessions(spark, d).select("sid", F.array_join("open_todos", "|").alias("todos"))


@query(f"""WITH {_EV}, {_TURN}, {_LIVE}, {_CMD}, o AS (SELECT sid, ord, said, coalesce(TRY_CAST(nullif(regexp_extract(said, '([0-9]+) failed', 1), '') AS INT), 0) AS f, coalesce(TRY_CAST(nullif(regexp_extract(said, '([0-9]+) passed', 1), '') AS INT), 0) AS p
  FROM cm WHERE kind = 'output' AND contains(command, 'pytest')), r AS (SELECT sid, ord, f > 0 OR (regexp_matches(said, 'Traceback|failed') AND regexp_matches(said, '\\bTraceback\\b|\\bfailed\\b') AND p = 0) AS broken,
  CASE WHEN f > 0 AND p > 0 THEN concat(p, ' passed, ', f, ' failed') WHEN f > 0 THEN concat(f, ' failed') WHEN p > 0 THEN concat(p, ' passed') WHEN regexp_matches(said, '\\bTraceback\\b|\\bfailed\\b') THEN 'failed' ELSE 'ran' END AS text FROM o)
  SELECT l.sid, arg_max(text, ord) AS text, arg_max(broken, ord) AS broken FROM live l LEFT JOIN r USING (sid) GROUP BY l.sid""")
def test_result(spark, d):
    return log_sessions(spark, d).select("sid", "tests.text", "tests.broken")


@query(f"""{_LOG}, x AS (SELECT sid, string_agg(concat(role, ': ', said), chr(10) || chr(10) ORDER BY ord) AS e, arg_max(role, ord) AS r, arg_max(said, ord) AS s FROM tn SEMI JOIN live USING (sid) GROUP BY sid)
  SELECT sid, CASE WHEN regexp_matches(right(e, 4000), '(?i)left off|pending|awaiting|next session|\\bTODO\\b|blocked') OR (r = 'ASSISTANT' AND regexp_matches(s, '(?i)should i\\b')) THEN 'open'
  WHEN regexp_matches(right(e, 4000), '(?i)\\bdone\\b|verified|merged|committed|pushed|complete') THEN 'done' ELSE 'unknown' END AS resolved FROM x""")
def resolved_flag(spark, d):
    return log_sessions(spark, d).select("sid", "resolved")


@query(f"""{_LOG}, x AS (SELECT sid, string_agg(lower(said), chr(10)) AS k FROM (SELECT sid, said FROM tn UNION ALL SELECT sid, said FROM ev WHERE kind = 'command') q SEMI JOIN live USING (sid) GROUP BY sid)
  SELECT sid, array_to_string(list_filter(['docker', 'python', 'pytest', 'git'], lambda w: regexp_matches(k, '\\b' || w || '\\b')), ',') AS keywords FROM x""")
def keyword_match(spark, d):
    return log_sessions(spark, d).select("sid", F.array_join("keywords", ",").alias("keywords"))


@query(f"""{_LOG}, x AS (SELECT b.sid, b.ord, (SELECT count(*) FROM tn t WHERE t.sid = b.sid AND t.ord < b.ord) AS turn FROM ev b SEMI JOIN live USING (sid) WHERE kind = 'boundary')
  SELECT DISTINCT sid, turn, 'precompact' AS event FROM x WHERE turn > 0""")
def boundaries_running(spark, d):
    return log_sessions(spark, d).select("sid", F.inline("boundaries")).select("sid", long("turn", "turn"), "event")


# --- privacy ------------------------------------------------------------------------------------------------------

@query("SELECT doc_id, md5(regexp_replace(text, '<private>.*?</private>', '[private]', 'gis')) AS text_md5 FROM @tagged")
def strip_private(spark, d):
    return lens(spark, d, "tagged").select("doc_id", F.md5(T.strip_private(F.col("text"))).alias("text_md5"))


@query("SELECT sid, cwd, contains(concat(rtrim(cwd, '/'), '/'), '/private-notes/') AS excluded FROM @sessions")
def glob_excluded(spark, d):
    return lens(spark, d, "sessions").select("sid", "cwd", T.cwd_excluded(F.col("cwd"), GLOBS).alias("excluded"))


@query("SELECT sid, CASE WHEN contains(cwd, 'private-notes/') THEN 'scrubbed' ELSE 'M' END AS op, CASE WHEN contains(cwd, 'private-notes/') THEN '[excluded-path]' ELSE concat(cwd, '/f.py') END AS path, CASE WHEN contains(cwd, 'private-notes/') THEN 1 ELSE 0 END AS n FROM @sessions")
def scrub_files(spark, d):
    files = F.array(F.struct(F.lit("M").alias("op"), F.concat("cwd", F.lit("/f.py")).alias("path")))
    s = lens(spark, d, "sessions").select("sid", files.alias("files"))
    return s.select("sid", T.n_scrubbed(F.col("files"), GLOBS).alias("n"), F.inline(T.scrub_files(F.col("files"), GLOBS)))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^see /home/u/private-notes/a[0-9]\\.md', 'see [excluded-path]'), ' -home-u-private-notes/b\\.txt ', ' [excluded-path] ')) AS text_md5, 2 AS n FROM @tagged""")
def scrub_text(spark, d):
    t = lens(spark, d, "tagged")
    return t.select("doc_id", F.md5(T.scrub_text(F.col("text"), GLOBS)).alias("text_md5"), T.n_scrubbed_text(F.col("text"), GLOBS).alias("n"))


# --- filters and look-up ------------------------------------------------------------------------------------------

def records(spark: SparkSession, d: str) -> DataFrame:
    s = lens(spark, d, "sessions")
    return s.withColumn("keywords", F.filter(F.split("keyword_list", ","), lambda x: x != ""))


def hay(spark_columns=("asked", "keyword_list", "repo", "cwd", "model", "native_id")):
    return search.haystack([F.col(c) for c in spark_columns])


@query("SELECT sid FROM @sessions WHERE list_contains(string_split(lower(keyword_list), ','), 'python') AND list_contains(string_split(lower(keyword_list), ','), 'docker')")
def filter_keyword(spark, d):
    return search.filters(records(spark, d), keywords=["Python", "DOCKER"]).select("sid")


@query("SELECT sid FROM @sessions WHERE contains(lower(repo), 'repo1') AND contains(lower(model), 'opal')")
def filter_substr(spark, d):
    return search.filters(records(spark, d), repo="REPO1", model="opal").select("sid")


@query("SELECT sid FROM @sessions WHERE date <> '' AND date >= '2024-02-10' AND date <= '2024-04-05'")
def filter_dates(spark, d):
    return search.filters(records(spark, d), since="2024-02-10", until="2024-04-05").select("sid")


@query("SELECT sid FROM @sessions WHERE harness = 'codex' AND coalesce(resolved, 'unknown') = 'unknown'")
def filter_equal(spark, d):
    return search.filters(records(spark, d), harness="codex", resolved="unknown").select("sid")


@query("WITH h AS (SELECT sid, CASE WHEN starts_with(sid, 'claude/c') THEN 0 ELSE 1 END AS t FROM @sessions WHERE contains(sid, 'claude/c')) SELECT sid FROM h WHERE t = (SELECT min(t) FROM h)")
def lookup_prefix(spark, d):
    return search.lookup(records(spark, d), "claude/c").select("sid")


@query("WITH h AS (SELECT sid, CASE WHEN starts_with(sid, 'c8') THEN 0 ELSE 1 END AS t FROM @sessions WHERE contains(sid, 'c8')) SELECT sid FROM h WHERE t = (SELECT min(t) FROM h)")
def lookup_substring(spark, d):
    return search.lookup(records(spark, d), "…c8").select("sid")


# --- ranked search ------------------------------------------------------------------------------------------------

_DECAY = f"round(pow(0.5::DOUBLE, greatest(coalesce(date_diff('day', TRY_CAST(nullif(date, '') AS DATE), DATE '{TODAY}'), 0), 0) / 90.0::DOUBLE), 12)"
_HAY = "lower(concat_ws(chr(10), nullif(asked, ''), nullif(keyword_list, ''), nullif(repo, ''), nullif(cwd, ''), nullif(model, ''), nullif(native_id, '')))"


@query(f"SELECT sid, date, {_DECAY} AS score FROM @sessions WHERE contains({_HAY}, 'the') ORDER BY score DESC, last_active DESC, sid DESC LIMIT 20")
def search_linear(spark, d):
    return search.search(records(spark, d), hay(), ["The"], TODAY).select("sid", "date", "score")


@query(f"SELECT sid, {_DECAY} AS score FROM @sessions")
def recency_view(spark, d):
    return search.search(records(spark, d), hay(), [], TODAY, limit=0).select("sid", "score")


def _bm25_sql(df: str, mean: str, tf: str, length: str) -> str:
    idf = f"ln((n - {df} + 0.5) / ({df} + 0.5))"
    return f"(CASE WHEN {idf} <= 0 THEN 0.000001 ELSE {idf} END) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {length} / {mean}))"


_WORDS = """t AS (SELECT doc_id AS sid, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\-._/]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
  st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t), tf AS (SELECT sid, len(w) AS length, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'apache')) AS b FROM t),
  df AS (SELECT count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tf)"""
_WORD_SCORE = f"round({_bm25_sql('da', 'mean', 'a', 'length')} + {_bm25_sql('db', 'mean', 'b', 'length')}, 10)"


def doc_records(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").where("text is not null")


@query(f"WITH {_WORDS} SELECT sid, {_WORD_SCORE} AS score FROM tf, st, df WHERE a > 0 AND b > 0")
def search_bm25_word_nostem(spark, d):
    index, lengths = search.postings(doc_records(spark, d), "doc_id", ["text"])
    return search.score_words(index, lengths, ["license", "Apache"])


_TRI = """h AS (SELECT doc_id AS sid, lower(text) AS h FROM documents WHERE text IS NOT NULL),
  g AS (SELECT sid, greatest(length(h) - 2, 0) AS length, len(list_filter(range(1, length(h) + 1), lambda i: substr(h, i, 4) = 'enen')) AS a FROM h), s2 AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (a > 0) AS da FROM g)"""
_TRI_SCORE = f"round({_bm25_sql('da', 'mean', 'a', 'length')}, 10)"


@query(f"WITH {_TRI} SELECT sid, {_TRI_SCORE} AS score FROM g, s2 WHERE a > 0")
def search_bm25_trigram(spark, d):
    return search.score_trigrams(doc_records(spark, d), "doc_id", F.lower("text"), ["Enen", "xy"])


@query(f"""WITH {_WORDS}, {_TRI}, r1 AS (SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS p FROM (SELECT sid, {_WORD_SCORE} AS score FROM tf, st, df WHERE a > 0 AND b > 0)),
  r2 AS (SELECT sid, row_number() OVER (ORDER BY score DESC, sid) AS p FROM (SELECT sid, {_TRI_SCORE} AS score FROM g, s2 WHERE a > 0))
  SELECT sid, round(sum(1::DOUBLE / (60 + p)), 12) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY sid""")
def search_rrf(spark, d):
    docs = doc_records(spark, d)
    index, lengths = search.postings(docs, "doc_id", ["text"])
    return search.fuse(search.score_words(index, lengths, ["license", "apache"]), search.score_trigrams(docs, "doc_id", F.lower("text"), ["enen"]))


_HAY = "array_to_string(list_filter([asked, keyword_list, repo, cwd, model, native_id], lambda x: x IS NOT NULL AND x <> ''), chr(10))"


@query(f"""WITH t AS (SELECT sid, date, last_active, lower({_HAY}) AS h FROM @sessions), w AS (SELECT *, list_filter(regexp_split_to_array(h, '[^\\p{{L}}\\p{{N}}\\-._/]+'), lambda x: x <> '') AS w FROM t),
  x AS (SELECT sid, date, last_active, len(w) AS length, len(list_filter(w, lambda x: x = 'python')) AS a, greatest(length(h) - 2, 0) AS l3, (length(h) - length(replace(h, 'python', ''))) // 6 AS b FROM w),
  st AS (SELECT count(*) AS n, avg(length) AS mean, avg(l3) AS mean3, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM x),
  one AS (SELECT sid, row_number() OVER (ORDER BY round({_bm25_sql('da', 'mean', 'a', 'length')}, 10) DESC, sid) AS p FROM x, st WHERE a > 0),
  two AS (SELECT sid, row_number() OVER (ORDER BY round({_bm25_sql('db', 'mean3', 'b', 'l3')}, 10) DESC, sid) AS p FROM x, st WHERE b > 0),
  f AS (SELECT sid, round(sum(1::DOUBLE / (60 + p)), 12) AS s FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY sid),
  k AS (SELECT sid, last_active, round(s * round(pow(0.5::DOUBLE, greatest(coalesce(date_diff('day', try_cast(date AS DATE), DATE '{TODAY}'), 0), 0) / 90.0::DOUBLE), 12), 12) AS score FROM f JOIN x USING (sid))
  SELECT sid, score FROM k ORDER BY score DESC, last_active DESC, sid DESC LIMIT 20""")
def search_stemmed(spark, d):
    """The whole ranked query: word and trigram lists, fused, decayed, cut."""
    return search.search(records(spark, d), hay(), ["python"], TODAY, engine="fts").select("sid", "score")


@query(f"""WITH {_WORDS}, ph AS (SELECT sid, length, len(list_filter(range(1, length), lambda i: w[i] = 'apache' AND w[i + 1] = 'license')) AS c FROM tf JOIN t USING (sid)), dc AS (SELECT count(*) FILTER (c > 0) AS dc FROM ph)
  SELECT sid, round({_bm25_sql('dc', 'mean', 'c', 'length')}, 10) AS score FROM ph, st, dc WHERE c > 0""")
def search_phrase(spark, d):
    """A term of two words counts where they stand one behind the other."""
    index, lengths = search.postings(doc_records(spark, d), "doc_id", ["text"])
    return search.score_words(index, lengths, ["Apache License"])


# --- sources: transcript files of both families --------------------------------------------------------------------

_SPOKEN = "s AS (SELECT conv_id, ord, upper(role) AS role, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM @turns WHERE text IS NOT NULL AND conv_id % 7 > 0)"
_TOLD = """u AS (SELECT * FROM s WHERE said <> '' AND (role = 'ASSISTANT' OR NOT starts_with(said, '<'))),
  live AS (SELECT conv_id, count(*) AS turn_count, md5(string_agg(concat(role, ': ', said), chr(10) || chr(10) ORDER BY ord)) AS excerpt_md5, max(ord) FILTER (role = 'ASSISTANT') AS last_said,
    min(ord) FILTER (role = 'USER') AS first_asked FROM u GROUP BY conv_id HAVING count(*) FILTER (role = 'USER') > 0),
  x AS (SELECT conv_id, max(ord) AS last_ord, count(DISTINCT ord % 5) AS n_files, count(DISTINCT ord % 2) AS n_mcp, count(*) AS n_helpers FROM s WHERE role = 'ASSISTANT' GROUP BY conv_id)"""


@query(f"""WITH {_SPOKEN}, {_TOLD} SELECT concat('claude/c', conv_id) AS sid, turn_count, excerpt_md5, concat('2024-05-', lpad((1 + first_asked % 28)::VARCHAR, 2, '0')) AS date, '/home/u/shop' AS cwd,
  'm-' || last_ord % 3 AS model, coalesce(n_files, 0) AS n_files, coalesce(n_mcp, 0) AS n_mcp, coalesce(n_helpers, 0) AS n_helpers, CASE WHEN last_ord % 2 = 1 THEN 'step ' || last_ord ELSE '' END AS todos,
  CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS warnings FROM live LEFT JOIN x USING (conv_id)""")
def transcripts_first_family(spark, d):
    """Files of the first family, listed, read, dispatched and folded."""
    return _extracted(spark, d, "claude")


@query(f"""WITH {_SPOKEN}, {_TOLD} SELECT concat('codex/', lpad(conv_id::VARCHAR, 8, '0'), '-0000-4000-8000-000000000000') AS sid, turn_count, excerpt_md5, concat('2024-05-', lpad((1 + first_asked % 28)::VARCHAR, 2, '0')) AS date, '/w' AS cwd,
  'm-' || last_ord % 3 AS model, coalesce(n_files, 0) AS n_files, coalesce(n_mcp, 0) AS n_mcp, coalesce(n_helpers, 0) AS n_helpers, CASE WHEN last_ord % 2 = 1 THEN 'step ' || last_ord ELSE '' END AS todos,
  CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS warnings FROM live LEFT JOIN x USING (conv_id)""")
def transcripts_second_family(spark, d):
    """Files of the second family: the header's gate, two channels of turns, items and calls."""
    return _extracted(spark, d, "codex")


def _extracted(spark, d, family):
    r = logs.extract(spark, [written(spark, d, family)], family)
    helpers = F.aggregate("subagents", F.lit(0).cast("long"), lambda a, s: a + s["count"])
    return r.select("sid", long("turn_count", "turn_count"), F.md5("excerpt").alias("excerpt_md5"), "date", "cwd", "model", long(F.size("files"), "n_files"), long(F.size("mcp"), "n_mcp"), helpers.alias("n_helpers"),
                    F.array_join("open_todos", ",").alias("todos"), long("parse_warnings", "warnings"))


# --- rendering ----------------------------------------------------------------------------------------------------

_QUOTE = lambda c: f"CASE WHEN regexp_full_match({c}, '[A-Za-z0-9_@%+=:,./-]+') THEN {c} ELSE '''' || replace({c}, '''', '''\"''\"''') || '''' END"
_RESUME = f"concat('cd ', CASE WHEN cwd = '' THEN '.' ELSE {_QUOTE('cwd')} END, CASE WHEN harness = 'codex' THEN ' && codex resume ' ELSE ' && claude --resume ' END, native_id)"
_ONE = "trim(regexp_replace(asked, '\\s+', ' ', 'g'))"


@query(f"""SELECT sid, concat_ws('  ', CASE WHEN date = '' THEN '??????????' ELSE date END, concat(upper(harness[1]), harness[2:], CASE WHEN model IS NOT NULL THEN concat('(', model, ')') ELSE '' END),
  CASE WHEN cwd = '' THEN '?' ELSE array_to_string(list_filter(string_split(cwd, '/'), lambda x: x <> '')[-2:], '/') END, concat(harness, '/', native_id[1:8]),
  CASE WHEN asked = '' THEN '(summary pending)' WHEN length({_ONE}) <= 90 THEN {_ONE} ELSE rtrim({_ONE}[1:90]) || '…' END) AS line FROM @sessions""")
def render_compact(spark, d):
    c = F.col
    return records(spark, d).select("sid", render.compact(c("date"), c("harness"), c("model"), c("cwd"), c("sid"), c("asked")).alias("line"))


@query(f"SELECT sid, {_RESUME} AS line FROM @sessions")
def render_resume(spark, d):
    return records(spark, d).select("sid", T.resume_string(F.col("harness"), F.col("cwd"), F.col("native_id")).alias("line"))


@query("""SELECT concat('{"sid":"', sid, '","harness":"', harness, '","date":"', date, '","model":', CASE WHEN model IS NULL THEN 'null' ELSE concat('"', model, '"') END, '}') AS line FROM @sessions""")
def render_ndjson(spark, d):
    return records(spark, d).select(render.ndjson(["sid", "harness", "date", "model"]).alias("line"))


def full_records(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with all columns of a record, filled by the conversation's number."""
    r, i = lens(spark, d, "sessions"), F.col("conv_id")
    some = lambda k, value, kind: F.when(i % k == 0, value).otherwise(F.array().cast(f"array<{kind}>"))
    pair = lambda a, b, x, y: F.struct(F.lit(x).alias(a), F.lit(y).alias(b))
    summary = F.struct(*(F.when(i % 4 > 0, "did  it\nall").otherwise("").alias(k) if k == "completed" else F.when(F.lit(k == "asked"), F.col("asked")).otherwise("").alias(k) for k in P.SUMMARY_FIELDS))
    return r.withColumns({
        "branch": F.when(i % 2 == 0, "main"), "forked_from": F.when(i % 6 == 0, "f6"), "summary": summary, "keywords": F.filter(F.split("keyword_list", ","), lambda x: x != ""),
        "skills": some(2, F.array(F.lit("review"), F.lit("plan")), "string"), "files": some(3, F.array(pair("op", "path", "C", "a.py"), pair("op", "path", "M", "b c.py")), "struct<op:string,path:string>"),
        "commits": some(4, F.array(pair("sha", "subject", "abc1234", "Fix it")), "struct<sha:string,subject:string>"), "prs": some(5, F.array(F.lit("https://x/1")), "string"),
        "subagents": some(2, F.array(F.struct(F.lit("helper").alias("type"), F.lit(2).alias("count"))), "struct<type:string,count:int>"), "mcp": some(3, F.array(F.lit("srv")), "string"),
        "open_todos": some(4, F.array(F.lit("one"), F.lit("two")), "string"), "tests": F.when(i % 5 == 0, F.struct(F.lit("2 failed").alias("text"), F.lit(True).alias("broken"))),
        "excerpt": F.when(i % 3 > 0, F.concat(F.lit("USER: "), F.repeat(F.lit("hello "), (i % 90).cast("int"))))})


_BLOCK = f"""concat_ws(chr(10), '● ' || sid, concat('  ', date, ' · ', upper(harness[1]), harness[2:], CASE WHEN model IS NOT NULL THEN concat(' (', model, ')') ELSE '' END, ' · resolved=', coalesce(resolved, 'unknown')),
  '  cwd:    ' || CASE WHEN cwd = '' THEN '-' ELSE cwd END, concat('  repo:   ', coalesce(repo, '-'), CASE WHEN conv_id % 2 = 0 THEN ' (branch: main)' ELSE '' END), '  active: ' || last_active, CASE WHEN conv_id % 6 = 0 THEN '  forked_from: f6' END,
  CASE WHEN asked <> '' OR conv_id % 4 > 0 THEN '  summary:' ELSE concat('  summary: (pending — state ', summary_state, ')') END, CASE WHEN asked <> '' THEN '    Asked: ' || {_ONE} END, CASE WHEN conv_id % 4 > 0 THEN '    Completed: did it all' END,
  CASE WHEN keyword_list <> '' THEN '  keywords: ' || replace(keyword_list, ',', ', ') END, CASE WHEN conv_id % 2 = 0 THEN '  skills: review, plan' END, CASE WHEN conv_id % 3 = 0 THEN '  files (2):' ELSE '  files (0):' END,
  CASE WHEN conv_id % 3 = 0 THEN concat('    C a.py', chr(10), '    M b c.py') END, CASE WHEN conv_id % 4 = 0 THEN concat('  commits (1):', chr(10), '    abc1234 Fix it') ELSE '  commits (0):' END, CASE WHEN conv_id % 5 = 0 THEN '  prs: https://x/1' END,
  CASE WHEN conv_id % 2 = 0 THEN '  subagents: helper×2' END, CASE WHEN conv_id % 3 = 0 THEN '  mcp: srv' END, CASE WHEN conv_id % 4 = 0 THEN concat('  open_todos:', chr(10), '    - one', chr(10), '    - two') END,
  CASE WHEN conv_id % 5 = 0 THEN '  tests: 2 failed (broken=True)' END, '  resume: ' || {_RESUME})"""


@query(f"SELECT sid, {_BLOCK} AS block FROM @sessions")
def render_full(spark, d):
    return full_records(spark, d).select("sid", render.full().alias("block"))


@query(f"""SELECT sid, concat_ws(chr(10), {_BLOCK}, '--- transcript tail ---', CASE WHEN conv_id % 3 > 0 THEN right('USER: ' || repeat('hello ', (conv_id % 90)::INT), 400) ELSE '(transcript not available)' END, {_RESUME}) AS shown FROM @sessions""")
def show_record(spark, d):
    r = full_records(spark, d)
    return render.show(r, r.select("sid", "excerpt"), 400)


# --- segments -----------------------------------------------------------------------------------------------------

def counted(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with their number of turns and two boundaries."""
    t = lens(spark, d, "turns").groupBy("conv_id").agg(F.count("*").cast("int").alias("turn_count"))
    marks = F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(e).alias("event"), F.lit("auto").alias("trigger")) for k, e in ((2, "precompact"), (4, "stop"), (2, "stop"))))
    return t.withColumn("boundaries", marks).withColumn("segments", segments.no_segments())


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM @turns GROUP BY conv_id), b AS (SELECT conv_id, n, t, e FROM c, (VALUES (2, 'precompact'), (4, 'stop')) v(t, e) WHERE t <= n),
  s AS (SELECT conv_id, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY t), 0) AS start, t AS "end", e AS event FROM b UNION ALL SELECT conv_id, max(t), n, 'change' FROM b GROUP BY conv_id, n HAVING max(t) < n
    UNION ALL SELECT conv_id, 0, n, 'change' FROM b GROUP BY conv_id, n HAVING max(t) = n)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN event = 'change' THEN 99 ELSE start END) AS seq, start::BIGINT AS start, "end", event FROM s""")
def segments_cut(spark, d):
    c, none = counted(spark, d), F.lit(None).cast("string")
    cut = segments.cut(F.col("segments"), F.col("boundaries"), F.col("turn_count"), F.lit(10), F.lit("t"), none, none)
    return c.select("conv_id", F.inline(cut)).select("conv_id", long("seq", "seq"), long("start", "start"), long("end", "end"), "event")


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM @turns GROUP BY conv_id) SELECT conv_id, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY t), 0)::BIGINT AS start, t::BIGINT AS "end", e AS event
  FROM c, (VALUES (2, 'precompact'), (4, 'stop')) v(t, e) WHERE t <= n""")
def segments_ranges(spark, d):
    c = counted(spark, d)
    marks = c.select(F.col("conv_id").alias("sid"), F.inline("boundaries"))
    ends = c.select(F.col("conv_id").alias("sid"), F.lit(0).alias("last_end"), "turn_count")
    return segments.boundary_ranges(marks, ends).select(F.col("sid").alias("conv_id"), long("start", "start"), long("end", "end"), "event")


@query("SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (ord >= 1 AND ord < 3), '') AS text FROM @turns GROUP BY conv_id")
def segments_slice(spark, d):
    t = lens(spark, d, "turns").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("turns"))
    return t.select("conv_id", segments.slice_turns(F.col("turns"), F.lit(1), F.lit(3)).alias("text"))


@query("""SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'pending' WHEN 2 THEN 'partial' WHEN 3 THEN 'done' ELSE 'error' END AS state FROM @sessions""")
def rollup_state(spark, d):
    states = [[], ["pending", "error"], ["done", "pending"], ["error", "done"], ["error"]]
    one = lambda v: F.array(*(F.lit(x) for x in v)) if v else F.array().cast("array<string>")
    pick = F.element_at(F.array(*(one(v) for v in states)), (F.col("conv_id") % 5 + 1).cast("int"))
    return lens(spark, d, "sessions").select("conv_id", _rolled(pick).alias("state"))


def _rolled(states):
    full = segments.segment(F.lit(1), F.lit("stop"), F.lit(None).cast("string"), F.lit(0), F.lit(1), F.lit(1), F.lit("t"))
    return segments.rollup(F.transform(states, lambda v: full.withField("state", v)), F.lit("stale"))


@query("SELECT conv_id, CAST(floor((row_number() OVER (ORDER BY sid) - 1) / 8) AS BIGINT) AS batch FROM @sessions")
def batches_of_8(spark, d):
    return segments.batches(lens(spark, d, "sessions").withColumn("seq", F.lit(0))).select("conv_id", "batch")


@query("""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS e FROM @turns GROUP BY conv_id) SELECT sid, CASE WHEN length(e) <= 6000 THEN e ELSE e[1:4000] || chr(10) || '...[trimmed]...' || chr(10) || right(e, 2000) END AS text
  FROM @sessions JOIN c USING (conv_id) WHERE summary_state IN ('pending', 'stale', 'error') AND trim(e) <> ''""")
def work_select(spark, d):
    t = lens(spark, d, "turns").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("turns"))
    r = lens(spark, d, "sessions").join(t, "conv_id").withColumn("segments", segments.no_segments()).withColumn("excerpt", F.array_join("turns", "\n\n"))
    return segments.work(r).select("sid", "text")


@query("SELECT sid, CASE WHEN conv_id % 3 = 0 THEN 'codex' WHEN conv_id % 3 = 1 THEN harness WHEN harness = 'claude' THEN 'claude' END AS by FROM @sessions WHERE conv_id % 3 < 2 OR harness = 'claude'")
def work_assign(spark, d):
    """Which summarizer takes a session, by preference and by what there is."""
    s = lens(spark, d, "sessions")
    parts = [segments.assign(s.where("conv_id % 3 = 0"), "codex", ["claude", "codex"]), segments.assign(s.where("conv_id % 3 = 1"), "same", ["claude", "codex"]),
             segments.assign(s.where("conv_id % 3 = 2 and harness = 'claude'"), "codex", ["claude"]), segments.assign(s, "same", [])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("sid", "by")


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM @turns GROUP BY conv_id), b AS (SELECT conv_id, n, t, e FROM c, (VALUES (2, 'precompact'), (4, 'stop')) v(t, e) WHERE t <= n),
  s AS (SELECT conv_id, t AS place, e AS event FROM b UNION ALL SELECT conv_id, 99, 'change' FROM b GROUP BY conv_id), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS seq FROM s)
  SELECT conv_id::VARCHAR AS sid, seq::INTEGER AS seq, string_agg('+' || length(event), '') OVER (PARTITION BY conv_id ORDER BY seq) AS answer FROM q""")
def backfill_rollup(spark, d):
    """Segments in order through a stand-in summarizer that counts characters."""
    c, none = counted(spark, d), F.lit(None).cast("string")
    cut = segments.cut(F.col("segments"), F.col("boundaries"), F.col("turn_count"), F.lit(10), F.lit("t"), none, none)
    items = c.select(F.col("conv_id").cast("string").alias("sid"), F.inline(cut)).select("sid", "seq", F.col("event").alias("text"))
    return segments.summarize(items, lambda text, previous: f"{previous}+{len(text)}")


@query("""SELECT conv_id, 'fix ' || CAST(conv_id AS STRING) AS asked, '' AS learned, 'all of it' AS completed, 'nothing' AS left_off, '' AS next_steps, CASE WHEN conv_id % 2 = 0 THEN 'done' END AS resolved FROM @sessions WHERE conv_id % 3 > 0""")
def summary_parse(spark, d):
    s = lens(spark, d, "sessions")
    answer = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("@@S1@@\n- **Asked:** fix "), F.col("conv_id").cast("string"), F.lit("\n- **completed:**  all of it \n- **Left off:** nothing\n- **Asked:** again\n- **Resolved:** "), F.when(F.col("conv_id") % 2 == 0, "Done").otherwise("maybe"))).otherwise("none")
    return s.select("conv_id", T.summary_fields(answer).alias("f")).where("f is not null").select("conv_id", "f.*")


# --- store --------------------------------------------------------------------------------------------------------

def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = lens(spark, d, "sessions")
    a = s.where("conv_id % 11 <> 0")
    b = s.where("conv_id % 4 <> 1").withColumn("date", F.when(F.col("conv_id") % 4 == 0, "2025-01-01").otherwise(F.col("date")))
    return a, b, s.where("conv_id % 17 = 0").select("sid")


@query("""SELECT sid, CASE WHEN conv_id % 11 <> 0 AND conv_id % 5 = 0 THEN 'purged' WHEN conv_id % 4 <> 1 AND conv_id % 5 = 0 THEN 'excluded' WHEN conv_id % 17 = 0 THEN 'tombstoned' WHEN conv_id % 4 <> 1 AND conv_id % 11 = 0 THEN 'new'
  WHEN conv_id % 4 = 0 THEN 'changed' ELSE 'kept' END AS action FROM @sessions WHERE conv_id % 11 <> 0 OR conv_id % 4 <> 1""")
def upsert_actions(spark, d):
    a, b, t = snapshots(spark, d)
    return store.actions(a, b, t, GLOBS, ["date", "cwd", "model"])


@query("""WITH x AS (SELECT CASE WHEN conv_id % 11 <> 0 AND conv_id % 5 = 0 THEN 'purged' WHEN conv_id % 4 <> 1 AND conv_id % 5 = 0 THEN 'excluded' WHEN conv_id % 17 = 0 THEN 'tombstoned' WHEN conv_id % 4 <> 1 AND conv_id % 11 = 0 THEN 'new'
  WHEN conv_id % 4 = 0 THEN 'changed' ELSE 'kept' END AS a FROM @sessions WHERE conv_id % 11 <> 0 OR conv_id % 4 <> 1)
  SELECT count(*) FILTER (a = 'new') AS new, count(*) FILTER (a = 'changed') AS changed, count(*) FILTER (a = 'kept') AS kept, count(*) FILTER (a = 'purged') AS purged, count(*) FILTER (a = 'excluded') AS excluded, count(*) FILTER (a = 'tombstoned') AS tombstoned, count(*) AS total FROM x""")
def ingest_counters(spark, d):
    return store.counters(upsert_actions(spark, d))


@query("""SELECT sid, CASE WHEN conv_id % 4 = 0 AND conv_id % 17 <> 0 THEN '2025-01-01' ELSE date END AS date FROM @sessions WHERE conv_id % 5 <> 0 AND ((conv_id % 4 <> 1 AND conv_id % 17 <> 0) OR conv_id % 11 <> 0)""")
def upsert_result(spark, d):
    a, b, t = snapshots(spark, d)
    return store.upsert(a, b, t, GLOBS, ["summary_state"]).select("sid", "date")


@query("SELECT sid FROM @sessions WHERE conv_id % 17 <> 0")
def tombstone_anti(spark, d):
    s = lens(spark, d, "sessions")
    return s.join(snapshots(spark, d)[2], "sid", "left_anti").select("sid")


@query("SELECT sid FROM @sessions WHERE NOT contains(concat(cwd, '/'), '/private-notes/')")
def forget_records(spark, d):
    s = lens(spark, d, "sessions")
    return store.forget(s, snapshots(spark, d)[2], T.cwd_excluded(F.col("cwd"), GLOBS))[0].select("sid")


@query("SELECT sid FROM @sessions WHERE contains(concat(cwd, '/'), '/private-notes/') UNION SELECT sid FROM @sessions WHERE conv_id % 17 = 0")
def forget_tombstones(spark, d):
    s = lens(spark, d, "sessions")
    return store.forget(s, snapshots(spark, d)[2], T.cwd_excluded(F.col("cwd"), GLOBS))[1].select("sid")


@query("SELECT sid, CASE WHEN conv_id % 11 = 0 THEN 'add' WHEN conv_id % 4 = 1 THEN 'delete' ELSE 'update' END AS change FROM @sessions WHERE (conv_id % 11 = 0 AND conv_id % 4 <> 1) OR (conv_id % 11 <> 0 AND conv_id % 4 IN (0, 1))")
def index_diff(spark, d):
    a, b, _ = snapshots(spark, d)
    return store.index_diff(a.withColumn("indexed_at", F.col("date")), b.withColumn("indexed_at", F.col("date")))


@query("SELECT sid AS key FROM @sessions WHERE conv_id % 3 = 0 OR conv_id % 2 = 0")
def watermark_skip(spark, d):
    s = lens(spark, d, "sessions")
    files = s.select(F.col("sid").alias("key"), F.lit(1).alias("mtime"), F.lit(100).alias("size"), "conv_id")
    marks = s.where("conv_id % 3 <> 0").select(F.col("sid").alias("key"), F.lit(0).alias("mtime"), F.when(F.col("conv_id") % 2 == 0, 90).otherwise(100).alias("size"))
    return store.changed_only(files, marks).select("key")


@query("""SELECT session_id, CASE WHEN conv_id % 9 = 0 THEN 'unknown' WHEN conv_id % 17 = 0 THEN 'tombstoned' WHEN conv_id % 11 = 0 THEN 'append' WHEN summary_state IN ('pending', 'stale', 'error') THEN 'merge' ELSE 'skip' END AS action
  FROM (SELECT *, CASE WHEN harness = 'codex' THEN concat('rollout-2024-01-01T00-00-00-', native_id[1:8], '-', native_id[9:12], '-', native_id[13:16], '-', native_id[17:20], '-', native_id[21:32]) ELSE native_id END AS session_id FROM @sessions)""")
def convert_merge(spark, d):
    s = lens(spark, d, "sessions")
    uuid = F.regexp_replace("native_id", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    s = s.withColumn("sid", F.when(F.col("harness") == "codex", F.concat(F.lit("codex/"), uuid)).otherwise(F.col("sid")))
    legacy = s.select(F.when(F.col("conv_id") % 9 == 0, "other").otherwise(F.col("harness")).alias("source"), F.when(F.col("harness") == "codex", F.concat(F.lit("rollout-2024-01-01T00-00-00-"), uuid)).otherwise(F.col("native_id")).alias("session_id"))
    return store.convert(s.where("conv_id % 11 <> 0"), legacy, s.where("conv_id % 17 = 0").select("sid")).select("session_id", "action")


@query("SELECT conv_id, 'fix it and more' AS asked, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'it is' END AS completed, '' AS left_off FROM @sessions")
def legacy_bullets(spark, d):
    blob = F.concat(F.lit("- **Asked:** fix it\n  and more\n- **Other:** x\n lost\n- **Done:** "), F.when(F.col("conv_id") % 2 == 0, "_(summary unavailable)_").otherwise("it is"))
    return lens(spark, d, "sessions").select("conv_id", store.legacy_bullets(blob).alias("f")).select("conv_id", "f.*")


@query("""SELECT harness, count(*) AS sessions, count(*) FILTER (summary_state IN ('pending', 'stale', 'partial')) AS pending, count(*) FILTER (summary_state = 'error') AS errors FROM @sessions GROUP BY ROLLUP (harness)""")
def status_rollup(spark, d):
    return store.status(lens(spark, d, "sessions"))


@query("SELECT sid, date, last_active FROM @sessions")
def latest_per_key(spark, d):
    s = lens(spark, d, "sessions")
    twice = s.withColumn("line", F.lit(2)).unionByName(s.withColumn("line", F.lit(1)).withColumn("date", F.lit("old")))
    return store.latest_per_key(twice, "sid", F.col("line")).select("sid", "date", "last_active")


@query("""WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id FROM e WHERE p IS NULL OR date_diff('second', p, ts) > 600""")
def hook_debounce(spark, d):
    """A hook event counts only where its session has been still for ten minutes: what the stream's debounce leaves."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return e.withColumn("gap", gap).where("gap is null or gap > 600").select("user_id", "event_id")
