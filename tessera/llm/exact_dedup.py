"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg 1972), DataFrame functions only.

The normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted into
integer names; adjacent names are paired and named again, level by level, until each document has one
name. Equal names at the end mean equal texts: no step relies on a hash being free of collisions. A hash
of a block is only its sorting prefix, and where two different blocks share it (min and max of the
blocks of one hash differ) the blocks themselves complete the sorting key.

Defined results: a null text counts as empty; empty texts are copies of each other; a row with a null
doc_id can be a copy, and stays only if all its copies have null ids; of repeated rows one stays; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, materialize, release, table, text_or_empty

BLOCK_BYTES = 4096


def _integer_names(keys: DataFrame, *by: str) -> DataFrame:
    """keys (distinct rows) sorted over all partitions; name is the place in that order."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, route) -> DataFrame:
    """One row per block: rid, doc_id, sha (first block only), n, idx, block, h."""
    data = F.regexp_replace(text_or_empty(text_col), SPACE, " ").cast("binary")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), data.alias("data"))
    n = F.greatest(F.lit(1), F.ceil(F.length("data") / block_bytes).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)))
    rows = base.select("rid", "doc_id", F.sha2("data", 256).alias("sha"), n.alias("n"), F.posexplode(cut).alias("idx", "block"))
    return rows.withColumn("sha", F.when(F.col("idx") == 0, F.col("sha"))).withColumn("h", route(F.col("block")))


def _level0(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, route) -> DataFrame:
    """Blocks with their integer names, without their text."""
    seen = materialize(
        _blocks(docs, id_col, text_col, block_bytes, route).groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).select("h", (F.col("lo") != F.col("hi")).alias("clash")),
        "op1-seen",
    )
    clashes = seen.where("clash").select("h", F.lit(True).alias("clash"))
    rows = _blocks(docs, id_col, text_col, block_bytes, route)
    if clashes.isEmpty():
        names = _integer_names(seen.select("h"), "h")
        occurrences = materialize(rows.drop("block"), "op1-blocks")
        out = occurrences.join(names, "h").drop("h")
        spare = (seen, occurrences)
    else:
        occurrences = materialize(rows.join(clashes, "h", "left").withColumn("block", F.when(F.col("clash"), F.col("block")).otherwise(F.lit(b""))).drop("clash"), "op1-blocks")
        names = _integer_names(occurrences.select("h", "block").distinct(), "h", "block")
        out = occurrences.join(names, ["h", "block"]).drop("h", "block")
        spare = (seen, occurrences)
    out = materialize(out, "op1-level0")
    release(*spare)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, route: "Callable[[Column], Column]" = F.xxhash64) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_blocks.

    route: what gives the sorting prefix of a block; any function gives the same groups.
    """
    level = _level0(docs, id_col, text_col, block_bytes, route).withColumn("blocks", F.col("n"))
    most = level.agg(F.max("n")).first()[0] or 1
    keep = ["rid", "doc_id", "sha", "blocks", "name"]
    done = [level.where("n = 1").select(keep)]
    while most > 1:
        pairs = (
            level.where("n > 1")
            .groupBy("rid", "blocks", F.expr("cast(ceil(n / 2) as int)").alias("n"), F.expr("idx div 2").cast("int").alias("idx"))
            .agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(idx % 2 = 1, name, null)")), F.lit(-1)).alias("b"))
        )
        pairs = materialize(pairs, "op1-pairs")
        names = _integer_names(pairs.select("a", "b").distinct(), "a", "b")
        level = materialize(pairs.join(names, ["a", "b"]).drop("a", "b"), "op1-level")
        release(pairs)
        most = (most + 1) // 2
        done.append(level.where("n = 1").select(keep))
    named = reduce(DataFrame.unionByName, done)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))).alias("first")
    # A table of its own, so that the join with it can split a group of many copies.
    groups = materialize(named.groupBy("blocks", "name").agg(first, F.count(F.lit(1)).alias("group_size")), "op1-groups")
    return named.join(groups, ["blocks", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("blocks").cast("long").alias("n_blocks")
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_blocks")


ORACLE_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
), g as (
  select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm
)
select t.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
