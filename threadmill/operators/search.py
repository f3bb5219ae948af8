"""Ranked search: linear match, word and trigram BM25, reciprocal rank fusion, recency, filters, top-N.

Corpus statistics (documents, mean length, documents with a term) are taken over the whole index, before any filter. Scores
are rounded before they rank, and ties fall to the greater last_active and sid, so that results do not depend on the engine.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from threadmill.functions import text as T
from threadmill.functions.porter import stem
from threadmill.functions.workers import importable
from threadmill.operators.ranking import positions

RRF_K, HALF_LIFE, LIMIT = 60, 90, 20
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TOKEN_GAP = r"[^\p{L}\p{N}\-._/]+"
#: Bits of a place inside a column; columns stand far apart, so that no phrase spans two.
COLUMN_BITS = 32
_LATIN = [chr(i) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(i) == chr(i).lower() and unicodedata.normalize("NFD", chr(i))[0].isascii() and len(unicodedata.normalize("NFD", chr(i))) > 1]
_PLAIN = [unicodedata.normalize("NFD", x)[0] for x in _LATIN]


def haystack(columns: list[Column]) -> Column:
    """All non-empty texts, one on a line, in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*(c.cast("string") for c in columns)), lambda x: x.isNotNull() & (x != "")), "\n"))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), TOKEN_GAP), "")


def fold_marks(c: Column) -> Column:
    """Lower case without diacritics of the Latin letters, as the word index compares."""
    return F.translate(F.lower(c), "".join(_LATIN), "".join(_PLAIN))


def phrase(term: str, stemmed: bool) -> list[str]:
    """A search term as the words of the index."""
    if not stemmed:
        return [w for w in re.split("[^\\w\\-./]+", term.lower()) if w]
    folded = term.lower().translate(dict(zip(map(ord, _LATIN), _PLAIN)))
    return [stem(w) for w in re.split("[^\\w\\-./]+", folded) if w]


@F.pandas_udf(StringType())
def stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def postings(docs: DataFrame, sid: str, columns: list[str], stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(term, sid, places) and (sid, length). Places are grouped where the text is, before any shuffle; of stemmed words each
    distinct one is stemmed once."""
    importable(docs.sparkSession)
    words = [tokens(fold_marks(F.coalesce(c, F.lit(""))) if stemmed else F.coalesce(c, F.lit(""))) for c in map(F.col, columns)]
    d = docs.select(F.col(sid).alias("sid"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    lengths = d.select("sid", sum((F.size(f"w{i}") for i in range(len(words))), F.lit(0)).cast("long").alias("length"))
    place = lambda i: lambda w, at: F.struct(w.alias("term"), (at.cast("long") + F.lit(i << COLUMN_BITS)).alias("at"))
    placed = F.flatten(F.array(*(F.transform(f"w{i}", place(i)) for i in range(len(words)))))
    found = d.select("sid", F.inline(placed)).groupBy("term", "sid").agg(F.sort_array(F.collect_list("at")).alias("places"))
    if stemmed:
        roots = found.select("term").distinct().select(F.col("term").alias("_w"), stems("term").alias("_s"))
        found = found.join(roots, F.col("term") == F.col("_w")).groupBy(F.col("_s").alias("term"), "sid").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return found, lengths


def bm25(tf: Column, length: Column, mean: Column, n: Column, df: Column) -> Column:
    """Positive score of one term, to ten digits."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def score_words(index: DataFrame, lengths: DataFrame, terms: list[str], stemmed: bool = False) -> DataFrame:
    """(sid, score) of the documents that hold every term; a term of several words is a phrase. Only the terms' postings are read."""
    phrases = sorted({tuple(p) for t in terms if (p := phrase(t, stemmed))})
    if not phrases:
        return lengths.select("sid", F.lit(0.0).alias("score")).where(F.lit(False))
    words = sorted({w for p in phrases for w in p})
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    hits = index.where(F.col("term").isin(words)).groupBy("sid").agg(*(F.first(F.when(F.col("term") == w, F.col("places")), ignorenulls=True).alias(f"w{i}") for i, w in enumerate(words)))

    def times(p: tuple[str, ...]) -> Column:
        """How often the words stand one behind the other."""
        back = lambda k: lambda x: x - k
        at = [F.transform(f"w{words.index(w)}", back(k)) for k, w in enumerate(p)]
        met = at[0]
        for x in at[1:]:
            met = F.array_intersect(met, x)
        return F.coalesce(F.size(met), F.lit(0))

    hits = hits.select("sid", *(times(p).alias(f"t{i}") for i, p in enumerate(phrases)))
    df = hits.agg(*(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(phrases))))
    for i in range(len(phrases)):
        hits = hits.where(F.col(f"t{i}") > 0)
    # two tables of one row
    rows = hits.join(lengths, "sid").join(F.broadcast(stats)).join(F.broadcast(df))
    total = sum((bm25(F.col(f"t{i}"), F.col("length"), F.col("mean"), F.col("n"), F.col(f"d{i}")) for i in range(len(phrases))), F.lit(0.0))
    return rows.select("sid", F.round(total, 10).alias("score"))


def score_trigrams(docs: DataFrame, sid: str, hay: Column, terms: list[str]) -> DataFrame:
    """(sid, score) by substring hits, overlapping ones included, of the terms of three characters or more."""
    want = sorted({t.lower() for t in terms if len(t) >= 3})
    d = docs.select(F.col(sid).alias("sid"), hay.alias("h"))
    if not want:
        return d.select("sid", F.lit(0.0).alias("score")).where(F.lit(False))
    counts = [F.regexp_count("h", F.lit(f"(?=\\Q{t}\\E)")).alias(f"t{i}") for i, t in enumerate(want)]
    d = d.select("sid", F.greatest(F.char_length("h") - 2, F.lit(0)).alias("length"), *counts)
    stats = d.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(want))))
    d = d.join(F.broadcast(stats))  # one row
    for i in range(len(want)):
        d = d.where(F.col(f"t{i}") > 0)
    total = sum((bm25(F.col(f"t{i}"), F.col("length"), F.col("mean"), F.col("n"), F.col(f"d{i}")) for i in range(len(want))), F.lit(0.0))
    return d.select("sid", F.round(total, 10).alias("score"))


def score_linear(docs: DataFrame, sid: str, hay: Column, terms: list[str]) -> DataFrame:
    """(sid, 1.0) of the documents whose text contains every term; all without terms."""
    d = docs.select(F.col(sid).alias("sid"), hay.alias("h"))
    for t in terms:
        d = d.where(F.contains("h", F.lit(t.lower())))
    return d.select("sid", F.lit(1.0).alias("score"))


def fuse(*lists: DataFrame, depth: int | None = None) -> DataFrame:
    """(sid, score) by reciprocal rank. ``depth`` keeps the best of each list only; None ranks them all."""
    ranked = []
    for one in lists:
        if depth:
            one = one.orderBy(F.desc("score"), F.asc("sid")).limit(depth)
        one = one.select("sid", "score")
        ranked.append(positions(one, "score", True, "sid").select("sid", (1 / (RRF_K + F.col("position"))).alias("r")))
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    return both.groupBy("sid").agg(F.round(F.sum("r"), 12).alias("score"))


def filters(records: DataFrame, *, keywords: list[str] | None = None, repo: str | None = None, cwd: str | None = None, model: str | None = None,
            harness: str | None = None, resolved: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Conjunctive filters; they reach the scan. ``keywords`` must all be there, in any case; null never matches a substring."""
    r = records
    if keywords:
        r = r.where(F.size(F.array_except(F.array(*(F.lit(k.lower()) for k in keywords)), F.transform("keywords", F.lower))) == 0)
    for name, want in (("repo", repo), ("cwd", cwd), ("model", model)):
        if want is not None:
            r = r.where(F.contains(F.lower(name), F.lit(want.lower())))
    if harness is not None:
        r = r.where(F.col("harness") == harness)
    if resolved is not None:
        r = r.where(F.coalesce("resolved", F.lit("unknown")) == resolved)
    if since is not None:
        r = r.where((F.col("date") != "") & (F.col("date") >= since))
    if until is not None:
        r = r.where((F.col("date") != "") & (F.col("date") <= until))
    return r


def rank(records: DataFrame, scores: DataFrame, today: str, limit: int = LIMIT) -> DataFrame:
    """Records joined to their scores, decayed by age, best first; a limit of 0 or less keeps all."""
    r = records.join(scores, "sid").withColumn("score", F.round(F.col("score") * T.decay(F.col("date"), today, HALF_LIFE), 12))
    r = r.orderBy(F.desc("score"), F.desc("last_active"), F.desc("sid"))
    return r.limit(limit) if limit > 0 else r


def lookup(records: DataFrame, needle: str) -> DataFrame:
    """Records whose sid starts with the needle; only if there are none, those that contain it. Latest first."""
    needle = needle.lstrip("…")
    if not needle:
        raise ValueError("an empty prefix names no session")
    hits = records.where(F.contains("sid", F.lit(needle))).withColumn("_tier", F.when(F.startswith("sid", F.lit(needle)), 0).otherwise(1))
    best = hits.agg(F.min("_tier").alias("_best"))
    return hits.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best").orderBy(F.desc("date"), F.desc("last_active"))


def resolve_one(records: DataFrame, needle: str):
    """The only record that a needle names; LookupError names up to two candidates."""
    rows = lookup(records, needle).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{needle!r}: " + (", ".join(r["sid"] for r in rows) if rows else "no session"))
    return rows[0]


def search(records: DataFrame, hay: Column, terms: list[str], today: str, engine: str = "linear", limit: int = LIMIT, **wanted) -> DataFrame:
    """The whole query: score over all records, filter, decay, order, cut."""
    if engine == "linear" or not terms:
        scores = score_linear(records, "sid", hay, terms)
    else:
        docs = records.select("sid", hay.alias("h"))
        index, lengths = postings(docs, "sid", ["h"], stemmed=True)
        scores = fuse(score_words(index, lengths, terms, stemmed=True), score_trigrams(docs, "sid", F.col("h"), terms))
    return rank(filters(records, **wanted), scores, today, limit)
