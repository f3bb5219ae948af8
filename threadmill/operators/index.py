"""The stored word index: postings with places in segments, and a narrow table of what is indexed.

A sync compares records by a hash of their searched texts, writes the postings of what is new or changed as one more segment, and
replaces the table (sid, indexed_at, length, text, segment). Postings of a record count only in the segment the table names, so nothing is
rewritten when records change or go; beyond SEGMENTS segments the live postings are merged into one. All of it becomes visible with
one manifest of the store. Table names carry the index's schema, so an index of another schema is dropped and made anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.operators import records as R
from threadmill.operators import search, store

SCHEMA, SEGMENTS = "index1", 8
DOCS, OF = f"{SCHEMA}_docs", f"{SCHEMA}_of"
_KIND = "sid string, indexed_at string, length bigint, text string, segment string"


def segment_tables(tables: dict[str, str]) -> list[str]:
    return sorted(t for t in tables if t.startswith(f"{SCHEMA}_p-"))


def complete(tables: dict[str, str]) -> bool:
    """Whether the manifest holds an index of this schema."""
    return {DOCS, OF} <= tables.keys()


def texts(sessions: DataFrame) -> DataFrame:
    """sid, the twelve texts, the haystack (text), and indexed_at with a hash of them."""
    d = sessions.select("sid", "indexed_at", *R.fts_columns(), search.haystack(R.search_text()).alias("text"))
    names = [c for c in d.columns if c not in ("sid", "indexed_at")]
    return d.withColumn("indexed_at", F.concat_ws("|", "indexed_at", F.xxhash64(*names).cast("string")))


def postings(of: store.Store, tables: dict[str, str]) -> DataFrame:
    """term, sid, places of all live postings."""
    live = of.read(DOCS, tables).select("sid", "segment")
    out = None
    for t in segment_tables(tables):
        one = of.read(t, tables).withColumn("segment", F.lit(t))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return of.spark.createDataFrame([], "term string, sid string, places array<bigint>")
    return out.join(live, ["sid", "segment"], "left_semi").select("term", "sid", "places")


def sync(of: store.Store) -> bool:
    """Bring the index up to the sessions table; False where it was already."""
    done = []

    def make(tables: dict[str, str]) -> dict[str, DataFrame | str | None]:
        if complete(tables) and tables[OF] == tables.get("sessions"):
            return {}
        done.append(True)
        old = of.read(DOCS, tables) if complete(tables) else of.spark.createDataFrame([], _KIND)
        gone: dict[str, None] = {} if complete(tables) else {t: None for t in tables if t.startswith("index")}
        wanted = texts(of.read("sessions", tables)) if "sessions" in tables else of.spark.createDataFrame([], "sid string, indexed_at string, text string")
        diff = of.scratch(store.index_diff(old, wanted))
        kept = old.join(diff, "sid", "left_anti")
        fresh = wanted.join(diff.where("change <> 'delete'"), "sid", "left_semi")
        names = [c for c in wanted.columns if c not in ("sid", "indexed_at", "text")]
        name = f"{SCHEMA}_p-{uuid.uuid4().hex[:12]}"
        found, lengths = search.postings(fresh, "sid", names, stemmed=True)
        docs = kept.unionByName(fresh.select("sid", "indexed_at", "text").join(lengths, "sid").withColumn("segment", F.lit(name)))
        # in the order of terms, so that a search reads few row groups
        ordered = lambda d: d.repartitionByRange("term").sortWithinPartitions("term", "sid")
        before = [] if gone else segment_tables(tables)
        if len(before) < SEGMENTS:
            return gone | {name: ordered(found), DOCS: docs, OF: tables.get("sessions", "")}
        live = postings(of, tables).join(kept.select("sid"), "sid", "left_semi")
        return {t: None for t in before} | {name: ordered(live.unionByName(found)), DOCS: docs.withColumn("segment", F.lit(name)), OF: tables.get("sessions", "")}

    if complete(tables := of.manifest()[1]) and tables[OF] == tables.get("sessions"):
        return False
    of.change(make)
    return bool(done)


def scores(of: store.Store, terms: list[str]) -> DataFrame:
    """(sid, score): the word list and the trigram list, fused."""
    tables = of.manifest()[1]
    docs = of.read(DOCS, tables)
    words = search.score_words(postings(of, tables), docs.select("sid", "length"), terms, stemmed=True)
    return search.fuse(words, search.score_trigrams(docs, "sid", F.col("text"), terms))
