"""Running counts over all rows of a table in an order, with no key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.session import stored


def running(rows: DataFrame, order: list[str], counted: Column, name: str) -> DataFrame:
    """rows with name: how many rows up to and with each, in order, have counted true. order names each row.

    Rows are dealt by range; a partition counts its own on top of those before it, of which there is a number for each
    partition.
    """
    dealt = stored(rows.withColumn("_one", F.when(counted, 1).otherwise(0)).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("_part").agg(F.sum("_one").alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    so_far = F.sum("_one").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + so_far).cast("long")).drop("_part", "_before", "_one")
