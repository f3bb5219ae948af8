"""Positions in a total order without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS, SAMPLES = 128, 32


def positions(df: DataFrame, by: str, descending: bool, tie: str, name: str = "position") -> DataFrame:
    """``df`` with the 1-based place of each row by ``by``, and by ``tie``, upwards, among equals.

    Rows are dealt to cells by borders drawn from a sample of at most CELLS * SAMPLES (by, tie) pairs or so, so that equal values are
    split, too; places count on from the sizes of the cells before, a table of at most CELLS rows. The borders only balance the work;
    the places don't depend on them.
    """
    n = df.count()
    share = min(1.0, CELLS * SAMPLES / max(n, 1))
    sign = -1 if descending else 1
    seen = sorted({(sign * r[0] if sign < 0 else r[0], r[1]) for r in df.where(F.col(by).isNotNull() & F.col(tie).isNotNull()).select(by, tie).sample(share, seed=1).collect()})
    step = max(1, -(-len(seen) // CELLS))
    value = -F.col(by) if descending else F.col(by)
    key = F.struct(value.alias("v"), F.col(tie).alias("t"))
    kind = f"struct<v:{df.select(value.alias('v')).schema['v'].dataType.simpleString()},t:{df.schema[tie].dataType.simpleString()}>"
    borders = [F.struct(F.lit(v).alias("v"), F.lit(t).alias("t")).cast(kind) for v, t in seen[step::step]]
    cell = F.size(F.filter(F.array(*borders), lambda b: b <= key)) if borders else F.lit(0)
    d = df.withColumn("_cell", F.when(F.col(by).isNull(), CELLS + 1).otherwise(cell))
    order = [F.desc(by) if descending else F.asc(by), F.asc(tie)]
    sums = d.groupBy("_cell").agg(F.count("*").alias("_c")).select(
        F.col("_cell").alias("_k"), (F.sum("_c").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_base"))
    placed = d.withColumn("_r", F.row_number().over(Window.partitionBy("_cell").orderBy(*order))).join(F.broadcast(sums), F.col("_cell") == F.col("_k"))
    return placed.withColumn(name, (F.col("_base") + F.col("_r")).cast("long")).drop("_cell", "_k", "_r", "_base")
