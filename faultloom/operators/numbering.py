"""Dense numbers within a key, without its rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`, their numbers from 1 in the given order within `by`; rows that `order` can't tell apart get theirs in any order.

    Rows are cut into ranges of key and order, whatever the sizes of keys. They are ranked within a range, and one row for each range and key says how many of the key
    come before, so only these counts meet by key. `by` may be empty.
    """
    ranged = cut_lineage(rows.repartitionByRange(*by, *order).withColumn("range_no", F.spark_partition_id()))
    sizes = ranged.groupBy("range_no", *by).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(*by).orderBy("range_no")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("range_no", *by).orderBy(*order))
    # Keys may be null, as range and key decide together.
    same = F.col("r.range_no") == F.col("b.range_no")
    for c in by:
        same &= F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    held = ranged.withColumn("rank", rank).alias("r").join(before.alias("b"), same)
    return held.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("b.before") + F.col("r.rank")).alias(name))
