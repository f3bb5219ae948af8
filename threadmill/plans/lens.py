"""Lenses: the driver's tables seen as session data, in SQL that Spark and DuckDB read alike.

The tables hold none of the marks that transcripts have, so each lens derives them from keys with md5 and remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Conversations as turns; system lines drop out, turns count from 0.
TURNS = """
SELECT conv_id, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ord, turn
FROM conversations WHERE role IN ('user', 'assistant')
"""

#: One record per conversation, with the fields that are not derived from its text.
SESSIONS = """
SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS harness, md5(CAST(conv_id AS STRING)) AS native_id,
  concat(CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'codex' END, '/', md5(CAST(conv_id AS STRING))) AS sid,
  CASE WHEN conv_id % 13 = 0 THEN '' ELSE concat('2024-', lpad(CAST(1 + conv_id % 6 AS STRING), 2, '0'), '-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0')) END AS date,
  concat('2024-06-', lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0'), 'T10:00:00+00:00') AS last_active,
  CASE WHEN conv_id % 5 = 0 THEN '/home/u/private-notes/x' WHEN conv_id % 5 = 1 THEN '' WHEN conv_id % 5 = 2 THEN '/home/u/my proj' ELSE concat('/home/u/proj', CAST(conv_id % 3 AS STRING)) END AS cwd,
  CASE WHEN conv_id % 3 = 0 THEN 'Opal-4' WHEN conv_id % 3 = 1 THEN 'quartz-mini' ELSE NULL END AS model,
  CASE WHEN conv_id % 7 = 0 THEN NULL ELSE concat('acme/repo', CAST(conv_id % 4 AS STRING)) END AS repo,
  CASE WHEN conv_id % 3 = 0 THEN 'open' WHEN conv_id % 3 = 1 THEN 'done' ELSE NULL END AS resolved,
  CASE WHEN conv_id % 7 < 3 THEN 'docker,python' WHEN conv_id % 7 < 5 THEN 'Python' ELSE '' END AS keyword_list,
  CASE WHEN conv_id % 4 = 0 THEN '' ELSE text END AS asked,
  CASE WHEN conv_id % 4 = 0 THEN 'pending' WHEN conv_id % 4 = 1 THEN 'done' WHEN conv_id % 4 = 2 THEN 'stale' ELSE 'error' END AS summary_state
FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) AS c WHERE r = 1
"""

#: Events as the log of sessions of 24 steps: commands, outputs, turns, files and the rest, by position.
LOG = """
SELECT sid, ord, kind, CASE WHEN kind = 'turn' THEN CASE WHEN m = 5 THEN 'USER' ELSE 'ASSISTANT' END END AS role,
  CASE WHEN kind = 'cwd' THEN CASE WHEN ord % 5 = 0 THEN '' ELSE concat('/home/u/proj', CAST(g % 5 AS STRING)) END
       WHEN m = 1 THEN concat('git push origin feat-', CAST(ord % 7 AS STRING), '/x')
       WHEN m = 3 THEN concat(CASE WHEN ord % 5 = 0 THEN 'ls ' ELSE 'pytest -q tests/' END, event_type)
       WHEN m = 8 THEN concat('rm -f src/a', CAST(ord % 4 AS STRING), '.py && git rm "docs/b.md" ; echo done | rm $X y', CAST(ord % 3 AS STRING))
       WHEN kind = 'file' THEN CASE WHEN ord % 2 = 0 THEN 'C' ELSE 'M' END
       WHEN kind IN ('skill', 'subagent') THEN concat(kind, CAST(ord % 3 AS STRING))
       WHEN kind = 'model' THEN CASE WHEN ord % 3 = 0 THEN '<synthetic>' ELSE concat('model-', CAST(ord % 4 AS STRING)) END
       WHEN kind = 'boundary' THEN 'precompact' END AS a,
  CASE WHEN m = 2 THEN concat('[main ', substr(md5(CAST(ord AS STRING)), 1, 9), '] Fix ', event_type, ' with a subject that is rather long so that it has to be cut somewhere', chr(10),
              'https://github.com/acme/repo', CAST(g % 7 AS STRING), '/pull/', CAST(ord % 50 AS STRING), chr(10), 'On branch dev-', CAST(ord % 3 AS STRING))
       WHEN m = 4 THEN concat(CASE WHEN ord % 3 = 0 THEN concat(CAST(ord % 2 AS STRING), ' failed, ') ELSE '' END, CASE WHEN ord % 4 = 0 THEN 'Traceback' ELSE concat(CAST(ord % 9 AS STRING), ' passed') END)
       WHEN m = 5 THEN concat(CASE WHEN ord % 11 = 0 THEN '<tag> ' ELSE '' END, 'please fix the ', event_type, ' in python <private>', md5(CAST(ord AS STRING)), '</private> and docker ')
       WHEN m = 6 THEN concat(' done with ', event_type, CASE WHEN ord % 5 = 0 THEN '. Should I go on?' WHEN ord % 5 = 1 THEN ', TODO later' ELSE '' END)
       WHEN kind = 'file' THEN concat(CASE WHEN ord % 3 = 0 THEN concat('/home/u/proj', CAST(g % 5 AS STRING), '/') ELSE '' END, 'src/a', CAST(ord % 4 AS STRING), '.py')
       WHEN kind = 'todos' THEN concat('[{"content":"step ', CAST(ord % 4 AS STRING), '","status":"', CASE WHEN ord % 2 = 0 THEN 'completed' ELSE 'open' END, '"},{"content":"last","status":"open"}]')
       WHEN kind = 'boundary' THEN 'auto' END AS b,
  CASE WHEN m IN (1, 8) THEN 'c1' WHEN m = 3 THEN 'c2' WHEN m = 2 THEN CASE WHEN ord % 3 = 0 THEN 'c9' ELSE 'c1' END WHEN m = 4 THEN 'c2' END AS call_id,
  concat('2024-03-', lpad(CAST(1 + g % 28 AS STRING), 2, '0'), 'T', lpad(CAST(ord % 24 AS STRING), 2, '0'), ':00:00Z') AS ts
FROM (SELECT CAST(event_id AS BIGINT) AS ord, event_type, concat('s', CAST(CAST(floor(event_id / 24) AS BIGINT) AS STRING)) AS sid, CAST(floor(event_id / 24) AS BIGINT) AS g,
        CAST((event_id * 5 + floor(event_id / 24)) % 14 AS INT) AS m,
        CASE CAST((event_id * 5 + floor(event_id / 24)) % 14 AS INT) WHEN 0 THEN 'cwd' WHEN 1 THEN 'command' WHEN 2 THEN 'output' WHEN 3 THEN 'command' WHEN 4 THEN 'output'
          WHEN 5 THEN 'turn' WHEN 6 THEN 'turn' WHEN 7 THEN 'file' WHEN 8 THEN 'command' WHEN 9 THEN 'skill' WHEN 10 THEN 'subagent' WHEN 11 THEN 'todos' WHEN 12 THEN 'model' ELSE 'boundary' END AS kind
      FROM events) AS e
"""

#: Documents with private spans and paths put in front.
TAGGED = """
SELECT doc_id, concat('see /home/u/private-notes/a', CAST(doc_id % 5 AS STRING), '.md and ~/src/ok', CAST(doc_id % 3 AS STRING), '.py or -home-u-private-notes/b.txt ',
  CASE WHEN doc_id % 3 = 0 THEN concat('<PRIVATE>', md5(CAST(doc_id AS STRING)), chr(10), '</private> ') WHEN doc_id % 3 = 1 THEN '<private>open ' ELSE '' END, text) AS text
FROM documents WHERE text IS NOT NULL
"""

LENSES = {"turns": TURNS, "sessions": SESSIONS, "log": LOG, "tagged": TAGGED}


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lens over the Parquet tables of ``sf_dir``."""
    sql = LENSES[name]
    for table in ("conversations", "events", "documents"):
        sql = sql.replace(f"FROM {table}", f"FROM parquet.`{sf_dir}/{table}.parquet`")
    return spark.sql(sql)


def with_lenses(sql: str) -> str:
    """DuckDB text with the lenses it names as common table expressions."""
    used = [n for n in LENSES if f"@{n}" in sql]
    head = ", ".join(f"{n} AS ({LENSES[n].strip()})" for n in used)
    for n in used:
        sql = sql.replace(f"@{n}", n)
    sql = sql.strip()
    if not used:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"
