"""Sharding by proportional stratified interleaving (DataFrame functions only).

Each source is a stratum. Its rows get a rank in seeded-hash order; rank r of n becomes the fraction
(r - 1 + u) / n with one hash-drawn offset 0 <= u < 1 for each source, so that sources of a single row
spread over the whole scale. All rows sorted by that fraction carry the corpus mixture everywhere; cutting
the sequence into equal runs gives shards of the same mixture.

No window sees a whole source: ranks are taken inside (source, hash bucket) cells, and cell sizes are
summed up before they are added. The final order is cut the same way into cells of the fraction. The number of cells grows with
the rows, so that a cell stays small.

Edge cases: a null source is a stratum of its own; null texts have size 1 and the CRC of no bytes; a null
doc_id takes part like any value; identical rows are interchangeable; an empty table gives no rows; extra
columns are ignored. Equal texts are not kept together: the law is on counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, hash60, staged

#: Cells a source is cut into before its rows are ranked, and cells of the fraction, at least; rows of a cell or so; cells at most, as many
#: as one task may sum up and every task may hold.
SOURCE_CELLS, ORDER_CELLS, CELL_ROWS, MOST_CELLS = 512, 4096, 250_000, 1 << 20


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17, source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, position, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.col(source).alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"), crc32_text(text).alias("text_crc32"),
    )
    key = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "text_crc32", "size")]
    rows = rows.withColumn("_h", hash60(F.lit(str(seed)), *key))
    rows = staged(rows, "shard-rows")
    n_rows = rows.count()
    grown = lambda least: min(MOST_CELLS, max(least, n_rows // CELL_ROWS))
    source_cells, order_cells = grown(SOURCE_CELLS), grown(ORDER_CELLS)
    rows = rows.withColumn("_cell", F.pmod("_h", F.lit(source_cells)).cast("int"))

    by_source = Window.partitionBy("source").orderBy("_cell")
    cells = rows.groupBy("source", "_cell").agg(F.count("*").alias("_c")).select(
        F.col("source").alias("_s"), F.col("_cell").alias("_k"),
        (F.sum("_c").over(by_source.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
        F.sum("_c").over(Window.partitionBy("source")).alias("_n"),
    )
    in_cell = Window.partitionBy("source", "_cell").orderBy("_h", "doc_id", "text_crc32", "size")
    offset = hash60(F.lit(str(seed + 1)), F.coalesce(F.col("source"), F.lit("-")))
    start = F.pmod(offset, F.lit(1 << 30)) / F.lit(float(1 << 30))
    ranked = (
        rows.withColumn("_r", F.row_number().over(in_cell))
        .join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_k")))
        .withColumn("_f", (F.col("_before") + F.col("_r") - 1 + start) / F.col("_n"))
        .withColumn("_o", F.least(F.lit(order_cells - 1), F.floor(F.col("_f") * order_cells)).cast("int"))
        .select("doc_id", "source", "size", "text_crc32", "_h", "_f", "_o")
    )
    ranked = staged(ranked, "shard-ranked")

    # at most MOST_CELLS rows, so one task may sum them up and every task may hold them
    order = Window.orderBy("_o")
    sums = ranked.groupBy("_o").agg(F.count("*").alias("_c")).select(
        "_o", (F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_base"),
        F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    in_order = Window.partitionBy("_o").orderBy("_f", "_h", "source", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_p", F.row_number().over(in_order)).join(F.broadcast(sums), "_o")
    pos = (F.col("_base") + F.col("_p") - 1).cast("long")
    k, n = F.lit(shards).cast("long"), F.col("_all")
    small, extra = F.expr(f"_all div {shards}"), F.pmod(n, k)
    # the first n mod k shards have one row more
    shard = F.when(F.col("position") < extra * (small + 1), F.expr("position") / (small + 1)).otherwise(
        extra + (F.col("position") - extra * (small + 1)) / F.greatest(small, F.lit(1)))
    placed = placed.withColumn("position", pos).withColumn("shard", F.floor(shard).cast("int"))
    first = F.col("shard") * small + F.least(F.col("shard").cast("long"), extra)
    return placed.withColumn("slot", (F.col("position") - first).cast("long")).select(
        "doc_id", "source", "size", "text_crc32", "position", "shard", "slot")


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`interleave` over eight shards; its law is ``rows``."""
    return interleave(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


#: The CRC is computed byte by byte from its defining polynomial, as DuckDB has no function for it.
OP8_SQL = """
WITH RECURSIVE bits(k, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8),
raw AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
sized AS (SELECT doc_id, source, strlen(text) + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
   regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM raw, tab),
hashed AS (SELECT *, ('0x' || md5(concat_ws('|', '17', coalesce(CAST(doc_id AS VARCHAR), '-'), CAST(text_crc32 AS VARCHAR), CAST(size AS VARCHAR)))[1:15])::BIGINT AS h,
   (('0x' || md5(concat_ws('|', '18', coalesce(source, '-')))[1:15])::BIGINT % 1073741824)::DOUBLE / 1073741824.0::DOUBLE AS u FROM sized),
placed AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h % 512, h, doc_id NULLS FIRST, text_crc32, size) - 1 + u) / count(*) OVER (PARTITION BY source) AS f FROM hashed),
seq AS (SELECT *, row_number() OVER (ORDER BY f, h, source NULLS FIRST, doc_id NULLS FIRST, text_crc32, size) - 1 AS p, count(*) OVER () // 8 AS small, count(*) OVER () % 8 AS extra FROM placed),
cut AS (SELECT *, CASE WHEN p < extra * (small + 1) THEN p // (small + 1) ELSE extra + (p - extra * (small + 1)) // greatest(small, 1) END AS shard FROM seq)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (p - shard * small - least(shard, extra))::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM cut
"""
