"""Exact ranks of large groups without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed_rank(df: DataFrame, by: str, key: Column, digits: int = 4) -> DataFrame:
    """Adds rank (from 1) of each row in its group by md5(key), then key, and many, the group's size.

    Rows are ranked within buckets of leading digits; the rows of earlier buckets are added from a table of
    at most 16 ** digits rows a group. Rows with a null group form a group of their own; a null key ranks first."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    rows = df.withColumns({"_k": text, "_m": F.md5(text)}).withColumn("_b", F.substring("_m", 1, digits))
    sizes = rows.groupBy(F.col(by).alias("_g"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "many": F.sum("_n").over(Window.partitionBy("_g"))})
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy("_m", "_k")))
    out = rows.join(sizes, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    return out.withColumn("rank", F.col("_r") + F.col("_before")).drop("_k", "_m", "_b", "_g", "_c", "_n", "_before", "_r")


def stratified_split(df: DataFrame, by: str, key: Column, share: float) -> DataFrame:
    """Adds test: true for the given share of each group, rounded, chosen by hash."""
    return hashed_rank(df, by, key).withColumn("test", F.col("rank") <= F.round(share * F.col("many"))).drop("rank", "many")


def sequential_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds name: 1, 2, 3 and so on in the order of the columns given, which are to tell all rows apart. Rows are sorted in
    ranges; each range counts its own, and the driver's table of the ranges' sizes says where each begins."""
    from tessera.operators.state import materialize

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    ranged = materialize(ranged.withColumn("_row", F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
