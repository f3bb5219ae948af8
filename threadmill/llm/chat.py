"""Conversations from quoted replies (DataFrame functions only).

Lines that start with ``>`` are quotes; the number of marks is their level. Each quoted line is normalised and hashed
and joined, as of the quoting message, to the latest earlier message of the same conversation that says it unquoted. The
message that the most quoted text of level one comes from is the parent; without such a link it is the message before.
Roots and depths follow by pointer doubling, and the texts are left without quotes and attributions.
Ordered by (root_turn, depth, turn) every message stands behind the one it answers.

The as-of join is a running maximum inside (conversation, passage, block of turns) plus one over the blocks, so neither a
passage that a third of all messages share nor one endless conversation meets in one task.

Edge cases: null texts count as empty; rows with a null conv_id or turn are roots of their own and link with nothing;
rows that share conv_id and turn are versions of one message and get the same parent; lines that only hold marks or blanks
link with nothing; lines of any number of marks or blanks are read in linear time; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Turns of a block, blanks at a text's ends, the quote prefix (one character class: a group that repeats would recurse once for every mark),
#: and lines that introduce a quote.
TURNS = 256
BLANKS = " \t\n\x0b\f\r"
PREFIX = "^[ \\t]*>[> \\t]*"
ATTRIBUTION = "(?i)^(?:on|am|le|el) .{1,200}(?:wrote|schrieb|écrit|escribió).{0,80}:[ \\t]*$"


def level(line: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def normal(line: Column) -> Column:
    """A passage as it is compared: without marks, in lower case, each run of blanks one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, PREFIX, "")), "[ \\t\\r]+", " "))


def unquoted(text: Column) -> Column:
    lines = F.split(text, "\n")
    quoted = lambda i: F.coalesce(F.rlike(F.get(lines, i), F.lit(PREFIX)), F.lit(False))
    own = F.filter(lines, lambda x, i: ~F.rlike(x, F.lit(PREFIX)) & ~(F.rlike(x, F.lit(ATTRIBUTION)) & quoted(i + 1)))
    return F.btrim(F.array_join(own, "\n"), F.lit(BLANKS))


def latest_earlier(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """``quotes`` (conv, h, turn, ...) with ``source``, the greatest turn in ``sources`` (conv, h, turn) below their own."""
    block = F.floor(F.col("turn") / TURNS).alias("block")
    sources = sources.select("conv", "h", "turn", block).distinct()
    quotes = quotes.select("*", block)
    names = [c for c in quotes.columns if c not in ("conv", "h", "turn", "block")]
    both = quotes.select("conv", "h", "block", "turn", F.lit(0).alias("kind"), *names).unionByName(
        sources.select("conv", "h", "block", "turn", F.lit(1).alias("kind")), allowMissingColumns=True)
    # at equal turns quotes come first: they see what is strictly earlier
    inside = Window.partitionBy("conv", "h", "block").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(F.when(F.col("kind") == 1, F.col("turn"))).over(inside)).where("kind = 0")
    before = Window.partitionBy("conv", "h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy("conv", "h", "block").agg(F.max(F.when(F.col("kind") == 1, F.col("turn"))).alias("top"))
    tops = tops.withColumn("far", F.max("top").over(before)).where("far is not null").select("conv", "h", "block", "far")
    return near.join(tops, ["conv", "h", "block"], "left").withColumn("source", F.coalesce("near", "far")).drop("near", "far", "block", "kind")


def parents(messages: DataFrame) -> DataFrame:
    """conv, turn, parent (null: none), n_quoted and n_linked lines of every message; one row for each (conv, turn)."""
    m = messages.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.where("conv is not null and turn is not null")
    lines = m.select("conv", "turn", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("conv", "turn", level(F.col("line")).alias("level"), normal(F.col("line")).alias("said"))
    # the empty passage stands for the message itself: its latest earlier source is the message before
    lines = lines.where("said <> ''").unionAll(m.select("conv", "turn", F.lit(0), F.lit("")).distinct())
    lines = staged(lines.select("conv", "turn", "level", F.md5("said").alias("h"), F.char_length("said").alias("size")), "chat-lines")
    itself = F.col("size") == 0
    quotes = lines.where((F.col("level") > 0) | itself)
    found = latest_earlier(quotes, lines.where("level = 0").select("conv", "h", "turn"))
    votes = found.groupBy("conv", "turn", "source").agg(
        F.sum(F.when(F.col("level") == 1, F.col("size")).otherwise(0)).alias("weight"),
        F.sum(F.when(itself, 0).otherwise(1)).alias("lines"))
    linked = F.when(F.col("source").isNotNull(), F.col("lines")).otherwise(0)
    return votes.groupBy("conv", "turn").agg(
        F.max(F.when(F.col("source").isNotNull(), F.struct("weight", "source")))["source"].alias("parent"),
        F.sum("lines").alias("n_quoted"), F.sum(linked).alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """``links`` with root and depth: pointers are doubled until none moves, in log2 of the greatest depth rounds."""
    links = staged(links, "chat-links")
    start = links.select("conv", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    settled = [staged(start.where("depth = 0"), "chat-settled")]
    moving = staged(start.where("depth > 0"), "chat-moving")
    # only messages that haven't reached their root take part in a round
    while moving.limit(1).count():
        known = moving
        for s in settled:
            known = known.unionByName(s)
        known = known.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        met = staged(moving.join(known, ["conv", "up"]), "chat-met")
        settled.append(met.where("more = 0").select("conv", "turn", "up", "depth"))
        moving = met.where("more > 0").select("conv", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
    at = settled[0]
    for s in settled[1:]:
        at = at.unionByName(s)
    return links.join(at.select("conv", "turn", F.col("up").alias("root"), "depth"), ["conv", "turn"])


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, depth, n_quoted, n_linked and the text without quotes of every row."""
    t = staged(threads(parents(messages)), "chat-threads").select(
        F.col("conv").alias("_c"), F.col("turn").alias("_t"), "parent", "root", "depth", "n_quoted", "n_linked")
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", unquoted(F.coalesce("text", F.lit(""))).alias("text"))
    m = m.join(t, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    return m.select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "text")


def mails(conversations: DataFrame) -> DataFrame:
    """The table's messages as mails that quote what they answer, for it holds none: whole, in part, or nested, by turn."""
    c = conversations.select("conv_id", "turn", "role", "text")
    one, two = (c.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(n)) for k, n in ((1, "t1"), (2, "t2")))
    d = c.join(one, ["conv_id", "turn"], "left").join(two, ["conv_id", "turn"], "left")
    quote = lambda n: F.concat(F.lit("> "), F.replace(F.col(n), F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    first = lambda n: F.split_part(F.col(n), F.lit("\n"), F.lit(1))
    nested = F.concat(F.lit("> "), first("t1"), F.lit("\n>> "), first("t2"), F.lit("\n"))
    head = F.when(F.col("turn") % 5 == 4, quote("t2")).when(F.col("turn") % 3 == 1, quote("t1")).when(F.col("turn") % 3 == 2, nested)
    return d.select("conv_id", "turn", "role", F.concat(F.coalesce(head, F.lit("")), "text").alias("text"))


def op5(conversations: DataFrame) -> DataFrame:
    return link(mails(conversations))


OP5_SQL = """
WITH RECURSIVE d AS (SELECT c.conv_id, c.turn, c.role, c.text AS t0, a.text AS t1, b.text AS t2 FROM conversations c
   LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2),
m AS (SELECT conv_id, turn, role, coalesce(CASE WHEN turn % 5 = 4 THEN '> ' || replace(t2, chr(10), chr(10) || '> ') || chr(10)
          WHEN turn % 3 = 1 THEN '> ' || replace(t1, chr(10), chr(10) || '> ') || chr(10)
          WHEN turn % 3 = 2 THEN '> ' || split_part(t1, chr(10), 1) || chr(10) || '>> ' || split_part(t2, chr(10), 1) || chr(10) END, '') || t0 AS text FROM d),
l AS (SELECT conv_id, turn, pos, line, regexp_extract(line, '^[ \\t]*>[> \\t]*', 0) AS pre FROM
   (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m)),
n AS (SELECT conv_id, turn, pos, line, length(regexp_replace(pre, '[^>]', '', 'g')) AS lev,
   trim(regexp_replace(lower(substr(line, length(pre) + 1)), '[ \\t\\r]+', ' ', 'g')) AS said FROM l),
q AS (SELECT x.conv_id, x.turn, x.pos, x.lev, length(x.said) AS size, max(o.turn) AS source FROM n x
   LEFT JOIN n o ON o.conv_id = x.conv_id AND o.said = x.said AND o.lev = 0 AND o.turn < x.turn
   WHERE x.lev > 0 AND x.said <> '' GROUP BY ALL),
v AS (SELECT conv_id, turn, source, sum(CASE WHEN lev = 1 THEN size ELSE 0 END) AS w FROM q WHERE source IS NOT NULL GROUP BY ALL),
prev AS (SELECT a.conv_id, a.turn, max(b.turn) AS source, 0 AS w FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.turn < a.turn GROUP BY 1, 2),
best AS (SELECT conv_id, turn, source FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY w DESC, source DESC) AS r
   FROM (SELECT conv_id, turn, source, w FROM v UNION ALL SELECT * FROM prev)) WHERE r = 1),
k AS (SELECT conv_id, turn, count(*) AS n_quoted, count(source) AS n_linked FROM q GROUP BY 1, 2),
tree AS (SELECT m.conv_id, m.turn, m.turn AS root, 0::BIGINT AS depth FROM m LEFT JOIN best USING (conv_id, turn) WHERE source IS NULL
   UNION ALL SELECT b.conv_id, b.turn, t.root, t.depth + 1 FROM tree t JOIN best b ON b.conv_id = t.conv_id AND b.source = t.turn),
own AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) AS text FROM n WHERE lev = 0 GROUP BY 1, 2)
SELECT m.conv_id, m.turn, role, source AS parent_turn, root AS root_turn, depth, coalesce(n_quoted, 0)::BIGINT AS n_quoted,
   coalesce(n_linked, 0)::BIGINT AS n_linked, trim(coalesce(own.text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
FROM m LEFT JOIN best USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn) JOIN tree USING (conv_id, turn) LEFT JOIN own USING (conv_id, turn)
"""
