"""Compression classifier: two zstandard dictionaries, one from good and one from bad labelled text.

A text is compressed whole with either dictionary. The difference of the two sizes for each byte of text says which kind of
text it resembles; a logistic model calibrates it, where the text's length only shifts and scales the difference.
Nothing else goes into the score.

The fit uses a bounded sample of labelled rows: at most ``per_class`` rows of each label and ``class_bytes`` bytes of their
texts, in the order of a hash of their id; texts are taken whole. Each half of the sample makes dictionaries that the other half
is measured with, so the calibration sees only texts that are not in the dictionary; the final dictionaries hold both halves, whole texts as
long as ``dict_bytes`` has room. Scoring reads every row, whole, in one pass without a shuffle.

Edge cases: null counts as the empty text; an empty text says nothing and scores the share of good labels; a null doc_id is never
labelled and counts as held out or not by the text "" ; ids that repeat are scored each; if a class has no labelled
text every score is the share of good labels, 0.5 without any; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, small_batches, tidy

FOLDS, HELD_OUT_FOLD = 3, 1


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]  # none: the prior is every text's score
    prior: float
    level: int

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors of one worker."""

    def __init__(self, m: Model):
        self.weights, self.prior = np.array(m.weights), m.prior
        self.by = [compressor(d, m.level) for d in (m.good, m.bad)] if m.weights else []

    def score(self, texts: list[bytes]) -> np.ndarray:
        n = np.array([len(t) for t in texts])
        out = np.full(len(texts), self.prior)
        if self.by and n.any():
            some = np.flatnonzero(n)
            z = features(sizes(self.by, [texts[i] for i in some]), n[some]) @ self.weights
            out[some] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kind.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=kind, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(by: list[zstandard.ZstdCompressor], texts: list[bytes]) -> np.ndarray:
    return np.array([[len(c.compress(t)) for c in by] for t in texts], float).reshape(-1, 2)


def features(size: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From the sizes with the good and the bad dictionary, and the texts' own."""
    difference, length = 10 * (size[:, 1] - size[:, 0]) / n, np.log(n) / 10
    return np.stack([np.ones(len(n)), difference, difference * length, length, length**2], 1)


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int, seed: int) -> list[tuple[int, int, bytes]]:
    """(hash, label, text) of the sample: ids are chosen first, so that texts travel only for the chosen."""
    pick = hash60(F.lit(str(seed)), F.col("_id").cast("string"))
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .where(fold("_id") != HELD_OUT_FOLD).groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_pick", pick)
    )
    chosen = known.where(F.col("_y") == 1).orderBy("_pick", "_id").limit(per_class).unionAll(known.where(F.col("_y") == 0).orderBy("_pick", "_id").limit(per_class))
    # at most 2 * per_class ids: bounded, so every task may hold them
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where(F.octet_length("_t") > 0)
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_pick", "_id", "_y").agg(F.min("_t").alias("_t"))
    before = Window.partitionBy("_y").orderBy("_pick", "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum(F.octet_length("_t").cast("long")).over(before)).where(F.col("_sum") <= class_bytes)
    return sorted((r["_pick"], int(r["_y"]), r["_t"].encode()) for r in rows.select("_pick", "_y", "_t").collect())


def dictionary(texts: list[bytes], size: int) -> bytes:
    """Content for a raw dictionary: whole texts, in order, as far as they fit."""
    out, room = [], size
    for t in texts:
        if len(t) <= room:
            out.append(t)
            room -= len(t)
    return b"".join(out) or bytes(8)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Newton steps; every row weighs the same, so that the score is a probability. The weights are drawn towards what is known without
    any feature, the share of good rows, and the more so the smaller the sample is."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    centre, ridge = np.zeros(x.shape[1]), 0.01 + 50 / len(y)
    centre[0] = np.log(share / (1 - share))
    w = centre.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - centre)
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 10 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2500, class_bytes: int = 24_000_000,
        dict_bytes: int = 3_000_000, level: int = 9, seed: int = 5) -> Model:
    rows = labelled_sample(docs, labels, label, per_class, class_bytes, seed)
    side = {y: [t for _, v, t in rows if v == y] for y in (1, 0)}
    prior = len(side[1]) / len(rows) if rows else 0.5
    if min(map(len, side.values())) < 2:  # nothing to tell apart, or nothing to measure it with
        return Model(b"", b"", [], prior, level)
    x, y = [], []
    for k in (0, 1):
        by = [compressor(dictionary(v[k::2], dict_bytes), level) for v in side.values()]
        for label_, v in side.items():
            rest = v[1 - k :: 2]
            x.append(features(sizes(by, rest), np.array([len(t) for t in rest])))
            y += [float(label_)] * len(rest)
    w = logistic(np.concatenate(x), np.array(y))
    return Model(dictionary(side[1], dict_bytes), dictionary(side[0], dict_bytes), w.tolist(), prior, level)


def classify(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; a column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = [*docs.columns, out]
    text = docs.columns.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = model.scorer()
        for b in batches:
            score = s.score([t.encode() if t else b"" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{out}` double")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold() == HELD_OUT_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
