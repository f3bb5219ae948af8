"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

The results are written as Parquet in the shared folder and read again as the next stage's ``docs``. All stages but the last
return the columns of ``documents``. Null texts pass as empty ones do; an empty table comes out empty; extra columns of
``documents`` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import bpe, decontaminate, near, quality, secrets
from threadmill.llm.common import arrow_rows, fresh_dir, read, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Ids that a join may broadcast: 16 bytes and more each.
BROADCAST_ROWS = 500_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier calls bad; labelled rows outside the held-out fold are what it learned from."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs.select(*COLUMNS), model).where(F.col("score") >= 0.5).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least doc_id: five-word shingles, similarity of 0.8 or more.

    Rows are told apart by doc_id and set; of rows that repeat both one stays. Empty texts are in no group. In a group
    without any doc_id the set that sorts first stays.
    """
    rule = near.Rule(5, 80, 100)
    docs = docs.select(*COLUMNS)
    with arrow_rows(spark, 512):
        found = staged(near.join(docs, rule), "pipeline-near")
        own = F.col("doc_id").eqNullSafe(F.col("component_id"))
        losers = staged(found.where("digest is not null").where(~own).select("doc_id", "digest").distinct(), "pipeline-losers")
        repeats = staged(found.where("digest is not null").where(own).groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"), "pipeline-repeats")
        marked = near.with_digest(docs, rule)
        kept = _without(marked, losers)
        if repeats.limit(1).count():
            twice = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d"))
            again = repeats.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"))
            kept = _without(kept, repeats).unionByName(kept.join(again, twice, "left_semi").dropDuplicates(["doc_id", "digest"]))
        return kept.select(*COLUMNS)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` less (doc_id, digest) in ``rows``, which tasks hold only while they are few."""
    other = rows.select(F.col("doc_id").alias("_i"), F.col("digest").alias("_d"))
    other = F.broadcast(other) if other.count() <= BROADCAST_ROWS else other
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark passages make up a twentieth of the words or more; cut the passages out of the rest."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; no document goes."""
    return secrets.redact(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and token ids, with their number and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return bpe.tokens(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("BPE encoding and decoding", tokenize),
]

#: A compression classifier, a trained forest and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        to = fresh_dir(spark, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
