"""Benchmark decontamination by winnowing.

Words are lower-cased runs of digits, ASCII letters and non-ASCII characters. Of every ``window`` consecutive words
the k-word gram with the least hash is kept (the last among equals), so a span of that length shared by a document
and an item has the same kept gram in both, at the same place. Fingerprints are joined on these hashes, and a match is extended to the windows
around its gram: those whose words are the item's, by a 128-bit digest, are hits, and overlapping hits make up longer spans. An item of fewer
words is one window of its own length, looked up among all spans of that length.

The items' windows are told apart by their words, not by their items: a document row meets one row of the benchmark however
many items share a window, and sets of windows are turned into sets of items once for each set that occurs. The
benchmark's hashes go into bitmaps of fixed size that let document scans emit only windows that may match; the
exact join behind them loses nothing when the bitmaps fill up. The join broadcasts the benchmark only while it has at most
BROADCAST_ROWS windows and otherwise salts its keys, since one passage may occur in a third of all documents.

Edge cases: null texts have no words; items without words or without an id are ignored; an id that several rows of
the benchmark bear counts once; repeated documents are judged alike, each row for itself; texts and items of any length are
scanned whole; empty tables give no hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import bitmap, by_bytes, in_bitmap, small_batches, staged, tidy, utf8

BROADCAST_ROWS, SALTS = 100_000, 16
_FOUND = "array<struct<fp:bigint,win:binary,start:bigint,end:bigint>>"


class Winnower:
    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    def kept(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all windows of a batch, and the hash of the gram each keeps."""
        g, last = hashing.grams(h, self.k), self.window - 1
        if len(h) <= last:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        p = np.flatnonzero(row[: len(h) - last] == row[last:])
        least = g[p]
        for j in range(1, self.window - self.k + 1):
            least = np.minimum(least, g[p + j])
        return p, least

    def whole(self, row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All spans of n words, hashed apart from those of other lengths."""
        g = hashing.grams(h, n)
        p = np.flatnonzero(row[: len(g)] == row[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        return p, hashing.mix(g[p] + np.uint64(n))

    def scan(self, data: np.ndarray, at: np.ndarray, lengths: list[int] | None, seen: tuple[np.ndarray, np.ndarray] | None):
        """For a batch of texts: word counts, and (row, fingerprint, window's hash, window's digest, place, end) of its windows.

        lengths: short window lengths to look for; None: a row shorter than the window is one window.
        seen: bitmaps of fingerprints and of windows' hashes worth emitting; None: all.
        """
        counts, found = np.zeros(len(at) - 1, np.int64), []
        for i, j in by_bytes(at):
            start, end, row, h = hashing.words(data, at[i : j + 1], "alnum")
            n = np.bincount(row, minlength=j - i)
            counts[i:j] = n
            begin = np.concatenate([[0], np.cumsum(n)])
            lower = None
            for size in [0, *(lengths if lengths is not None else range(1, self.window))]:
                p, fp = self.whole(row, h, size) if size else self.kept(row, h)
                if size and lengths is None:
                    p, fp = (v[n[row[p]] == size] for v in (p, fp))
                if seen is not None:
                    p, fp = (v[in_bitmap(seen[0], fp)] for v in (p, fp))
                size = size or self.window
                span = hashing.grams(h, size)[p] if len(p) else np.zeros(0, np.uint64)
                if seen is not None:
                    p, fp, span = (v[in_bitmap(seen[1], span)] for v in (p, fp, span))
                if len(p) and lower is None:
                    lower = hashing.LOWER[data[at[i] : at[j]]].tobytes()
                base = int(at[i])
                for q, f, s in zip(p.tolist(), fp.view(np.int64).tolist(), span.view(np.int64).tolist()):
                    words = b" ".join([lower[x - base : y - base] for x, y in zip(start[q : q + size].tolist(), end[q : q + size].tolist())])
                    r = int(row[q])
                    found.append((i + r, f, s, xxhash.xxh3_128_digest(words), q - int(begin[r]), q - int(begin[r]) + size))
        return counts, found


def benchmark_windows(benchmark: DataFrame, w: Winnower) -> DataFrame:
    """fp, span, win, n (words of it) and item_id of every window of the items."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, found = w.scan(*utf8(b.column(1)), None, None)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x[c] for x in found], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary()))), pa.array([x[5] - x[4] for x in found], pa.int64()),
                 b.column(0).take(pa.array([x[0] for x in found], pa.int64()))], ["fp", "span", "win", "n", "item_id"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text")
    return rows.mapInArrow(run, f"fp bigint, span bigint, win binary, n bigint, item_id {kind}").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as doc_id, n_words, the hit spans (start, end in words), item_set (null: none found) and the columns ``keep``; and the
    sets: item_set and the ids of its items, sorted."""
    spark = docs.sparkSession
    small_batches(spark)
    w = Winnower(window, k)
    members = staged(benchmark_windows(benchmark, w), "winnow-items")
    wins = staged(members.select("fp", "span", "win", "n").distinct(), "winnow-windows")
    total = wins.count()
    # at most window - 1 numbers
    short = sorted(r[0] for r in wins.where(F.col("n") < window).select("n").distinct().collect())
    # sparse enough that few documents without a shared window pass; 8 MB each at most
    bits = int(np.clip(np.ceil(np.log2(256 * total + 1)), 16, 26))
    seen = bitmap(wins, "fp", bits), bitmap(wins, "span", bits)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            counts, found = w.scan(data, at, short, seen)
            found.sort(key=lambda x: x[0])
            per = np.bincount([x[0] for x in found], minlength=len(counts)) if found else np.zeros(len(counts), np.int64)
            item = pa.StructArray.from_arrays(
                [pa.array([x[c] for x in found], t) for c, t in ((1, pa.int64()), (3, pa.binary()), (4, pa.int64()), (5, pa.int64()))], ["fp", "win", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), item)
            # a row's key: equal rows share it, and share their result
            keys = [xxhash.xxh3_128_hexdigest(data[at[i] : at[i + 1]].tobytes()) if per[i] else "" for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.string()), lists, *b.columns[2:]], ["doc_id", "n_words", "key", "found", *held])

    keep = keep or []
    held = [f"_kept{i}" for i in range(len(keep))]
    kinds = "".join(f", {h} {docs.schema[c].dataType.simpleString()}" for h, c in zip(held, keep))
    rows = docs.select("doc_id", "text", *(F.col(c).alias(h) for h, c in zip(held, keep)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, key string, found {_FOUND}{kinds}")
    scanned = staged(scanned.withColumn("key", F.when(F.size("found") > 0, F.col("key"))), "winnow-docs")

    ours = scanned.where(F.col("key").isNotNull()).select("key", F.inline("found"))
    known = wins.select("fp", "win")
    if total <= BROADCAST_ROWS:
        met = ours.join(F.broadcast(known), ["fp", "win"])
    else:
        salt = F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int")
        met = ours.withColumn("salt", salt).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["fp", "win", "salt"])
    per_doc = met.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("win")).alias("wins"))
    per_doc = staged(per_doc.withColumn("item_set", F.sha1(F.array_join(F.transform("wins", F.hex), ""))), "winnow-hits")

    # each set of windows that occurs is looked up once
    sets = per_doc.groupBy("item_set").agg(F.min("wins").alias("wins")).select("item_set", F.explode("wins").alias("win"))
    sets = sets.join(members.select("win", "item_id").distinct(), "win").groupBy("item_set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    named = [F.col(h).alias(c) for h, c in zip(held, keep)]
    # rows without a candidate need no join
    found = scanned.where(F.col("key").isNotNull()).join(per_doc, "key", "left").select(
        "doc_id", "n_words", F.coalesce("spans", none).alias("spans"), "item_set", *named)
    return found.unionAll(scanned.where(F.col("key").isNull()).select("doc_id", "n_words", none.alias("spans"), F.lit(None).cast("string"), *named)), sets


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, the hit spans (start, end in words), the sorted ids of the items found, and the columns ``keep``, for each row of ``docs``."""
    rows, sets = hits(docs, benchmark, window, k, keep)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    named = ["doc_id", "n_words", "spans", "items", *(keep or [])]
    # rows without a set stay out of the join: they would all meet at one key
    clear = rows.where(F.col("item_set").isNull()).withColumn("items", F.array().cast(f"array<{kind}>"))
    return rows.where(F.col("item_set").isNotNull()).join(sets, "item_set").select(*named).unionAll(clear.select(*named))


def n_hit(spans: str):
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])


WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words inside the sorted spans; what stands between words stays."""
    out, at, k = [], 0, 0
    for i, m in enumerate(WORD.finditer(text)):
        while k < len(spans) and spans[k][1] <= i:
            k += 1
        if k == len(spans):
            break
        if spans[k][0] <= i:
            out.append(text[at : m.start()])
            at = m.end()
    return "".join(out) + text[at:]


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans as disjoint ones."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["end"]))
        else:
            out.append((s["start"], s["end"]))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 8, least_share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows, and the others without the words hit; their columns stay, n_chars is counted anew.

    A row is contaminated when ``least_share * hit words >= words``. Rows with equal doc_id and text share a result.
    """
    names = docs.columns
    d, _ = hits(docs, benchmark, window, k, keep=[c for c in names if c != "doc_id"])
    d = d.withColumn("_hit", n_hit("spans")).where((F.col("_hit") == 0) | (least_share * F.col("_hit") < F.col("n_words")))
    text = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(len(names)).to_pylist()
            if any(spans):
                texts = [cut_out(t, merged(s)) if s else t for t, s in zip(b.column(text).to_pylist(), spans)]
                cols = [*b.columns]
                cols[text] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    old = cols[names.index("n_chars")]
                    cols[names.index("n_chars")] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, old.to_pylist())], old.type)
                yield pa.RecordBatch.from_arrays(cols[: len(names)], names)
            else:
                yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return d.select(*names, "spans").mapInArrow(run, kinds)


def op4(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, sets = hits(docs, benchmark)
    # digests are made for each set, not for each document
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    sets = staged(sets.select("item_set", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256")), "winnow-sets")
    sets = F.broadcast(sets) if sets.count() <= BROADCAST_ROWS else sets
    rows = rows.withColumn("n_hit", n_hit("spans"))
    # rows without a set stay out of the join: they would all meet at one key
    clear = rows.where(F.col("item_set").isNull()).withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit(""), 256))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    d = rows.where(F.col("item_set").isNotNull()).join(sets, "item_set").select(*names).unionAll(clear.select(*names))
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


OP4_SQL = """
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
         FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM base, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, item_id, i, p.n FROM places p JOIN wins w ON p.s = w.s AND p.n = w.n),
words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM base LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
