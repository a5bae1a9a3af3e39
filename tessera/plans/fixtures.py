"""Rasters and points derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64

PX = """px as (
  select g.prow, g.pcol, coalesce(p.red, 0) as red, coalesce(p.green, 0) as green, coalesce(p.blue, 0) as blue, coalesce(p.nir, 0) as nir
  from (select a.i as prow, b.i as pcol from (select cast(unnest(range(64)) as int) i) a, (select cast(unnest(range(64)) as int) i) b) g
  left join (select cast(l_orderkey % 64 as int) prow, cast(l_partkey % 64 as int) pcol, max(cast(floor(l_quantity) as int)) red,
    max(cast(floor(l_extendedprice / 500) as int)) green, cast(sum(cast(round(l_discount * 100) as int)) as int) blue, cast(sum(cast(round(l_tax * 100) as int)) as int) nir
    from lineitem group by 1, 2) p on g.prow = p.prow and g.pcol = p.pcol)"""
PTS = """pts as (
  select event_id as id, cast((event_id * 7919) % 1009 + 1009 * (event_id // 10000) as int) as x, cast((event_id * 10473 + user_id * 31) % 1013 as int) as y,
    floor(value / 5) / 100 as score, cast(user_id % 7 as int) as tile_id from events)"""
REFPTS = "refpts as (select o_orderkey as id, cast(o_custkey as double) as wx, o_totalprice / 1000 as wy from orders)"

# A planted orchard: one crown for each nation, of three sizes, on a ground with a texture.
ORCHARD = """orchard as (
  select prow, pcol, k, case when d2 <= rad * rad then 60 else 80 + (prow * 5 + pcol * 3) % 7 end as red, case when d2 <= rad * rad then 200 - 4 * d2 else 60 + (prow * 7 + pcol * 13) % 11 end as green, 50 + (prow * 3 + pcol * 5) % 5 as blue
  from (select a.i as prow, b.i as pcol, cast(n_nationkey as int) as k, 3 + cast(n_nationkey as int) % 3 as rad, (a.i % 24 - 12) * (a.i % 24 - 12) + (b.i % 24 - 12) * (b.i % 24 - 12) as d2
    from (select cast(unnest(range(120)) as int) i) a, (select cast(unnest(range(120)) as int) i) b, nation where n_nationkey = (a.i // 24) * 5 + b.i // 24))"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 by 64 raster of four bands; cells without rows are 0, as a boundless read fills them."""
    i = lambda c: F.floor(c).cast("int")
    cells = (
        _read(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("prow"), (F.col("l_partkey") % SIDE).cast("int").alias("pcol"))
        .agg(F.max(i("l_quantity")).alias("red"), F.max(i(F.col("l_extendedprice") / 500)).alias("green"), F.sum(F.round(F.col("l_discount") * 100).cast("int")).cast("int").alias("blue"), F.sum(F.round(F.col("l_tax") * 100).cast("int")).cast("int").alias("nir"))
    )
    axis = lambda name: spark.range(SIDE).select(F.col("id").cast("int").alias(name))
    grid = axis("prow").withColumn("pcol", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return grid.join(cells, ["prow", "pcol"], "left").fillna(0, ["red", "green", "blue", "nir"])


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored points with ties and coincident places; a strip of its own for each 10,000, so the density is the same at every scale."""
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), ((F.col("event_id") * 7919) % 1009 + 1009 * F.floor(F.col("event_id") / 10000)).cast("int").alias("x"), ((F.col("event_id") * 10473 + F.col("user_id") * 31) % 1013).cast("int").alias("y"),
        (F.floor(F.col("value") / 5) / 100).alias("score"), (F.col("user_id") % 7).cast("int").alias("tile_id"),
    )


def refpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("wx"), (F.col("o_totalprice") / 1000).alias("wy"))


def orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prow, pcol, k (the nation whose plot it is), red, green, blue of 120 by 120 pixels."""
    grid = spark.range(120).select(F.col("id").cast("int").alias("prow")).withColumn("pcol", F.explode(F.sequence(F.lit(0), F.lit(119))))
    plot = grid.withColumn("k", (F.floor(F.col("prow") / 24) * 5 + F.floor(F.col("pcol") / 24)).cast("int"))
    known = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    at = lambda c: F.pow(F.col(c) % 24 - 12, F.lit(2)).cast("int")
    p = plot.join(known, "k").withColumns({"rad": 3 + F.col("k") % 3, "d2": at("prow") + at("pcol")}).withColumn("in", F.col("d2") <= F.col("rad") * F.col("rad"))
    return p.select(
        "prow", "pcol", "k", F.when(F.col("in"), 60).otherwise(80 + (F.col("prow") * 5 + F.col("pcol") * 3) % 7).alias("red"),
        F.when(F.col("in"), 200 - 4 * F.col("d2")).otherwise(60 + (F.col("prow") * 7 + F.col("pcol") * 13) % 11).alias("green"), (50 + (F.col("prow") * 3 + F.col("pcol") * 5) % 5).alias("blue"),
    )


def diamonds(spark: SparkSession, sf_dir: str, plot: int, reach: float, which: str = "n_nationkey % 3 = 0") -> DataFrame:
    """id, rings: a diamond in the middle of the plots of some nations."""
    n = _read(spark, sf_dir, "nation").where(which).select(F.col("n_nationkey").cast("int").alias("id"))
    x, y = F.col("id") % 5 * plot + plot / 2, F.floor(F.col("id") / 5) * plot + plot / 2
    corner = lambda dx, dy: F.array((x + dx).cast("double"), (y + dy).cast("double"))
    return n.select("id", F.array(F.array(corner(-reach, 0.0), corner(0.0, -reach), corner(reach, 0.0), corner(0.0, reach))).alias("rings"))
