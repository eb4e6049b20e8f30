"""Ranks and running sums within keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.session import stored


def ranked(df: DataFrame, keys: list[str], order: list[Column], value: str | None = None) -> DataFrame:
    """df with rank (from 1) and, for value, before (its sum over earlier rows) within each key.

    Rows are dealt by range of keys and order together, so that a hot key spans many partitions; each
    partition sends one count per key, whose running sums place its rows. Keys must not be null. df is
    read twice by the range partitioning, so hand in a stored table.
    """
    total = F.sum(value) if value else F.lit(0)
    dealt = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, "ranked")
    parts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), total.cast("long").alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_sum"),
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    so_far = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if value else F.lit(0)
    out = dealt.withColumns({"_rank": F.row_number().over(within), "_before": so_far}).join(parts, [*keys, "_part"])
    out = out.withColumns({"rank": F.col("_rank") + F.col("_rows"), "before": F.col("_before") + F.col("_sum")})
    return out.drop("_part", "_rank", "_before", "_rows", "_sum", *([] if value else ["before"]))
