"""Queries against DuckDB on sf0.001, and operators against brute force."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.operators import detection, forest, ranking, spatial, stats, tiles
from tessera.plans import detection as _added  # noqa: F401  adds to the registry
from tessera.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda r, names: sorted((tuple(x[names.index(c)] for c in cols) for x in r), key=repr)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_nms_equals_scan(spark):
    from pyspark.sql import functions as F

    rng = __import__("random").Random(2)
    points = [(i, rng.randrange(100), rng.randrange(100), rng.randrange(5) / 5) for i in range(300)]
    kept = []
    for p in sorted(points, key=lambda p: (-p[3], p[0])):
        if all(math.hypot(p[1] - k[1], p[2] - k[2]) >= 9 for k in kept):
            kept.append(p)
    got = spatial.suppress(spark.createDataFrame(points, "id long, x int, y int, score double"), 9.0, [(-F.col("score")).alias("s"), F.col("id").alias("k")])
    assert sorted(r.id for r in got.collect()) == sorted(k[0] for k in kept)


def test_report_golden(spark):
    """The published confusion matrix gives the published figures."""
    cells = [(0, 0, 5956), (0, 1, 205), (1, 0, 156), (1, 1, 1461)]
    df = spark.createDataFrame(cells, "t int, p int, n int").selectExpr("t", "p", "explode(sequence(1, n)) as k")
    got = {r.label: r for r in stats.classification_report(df, "t", "p").collect()}
    assert math.isclose(got[0].precision, 0.974476439790576) and math.isclose(got[1].recall, 0.9035250463821892) and math.isclose(got[1].f1, 0.8900395979287238)
    assert (got[0].support, got[1].support) == (6161, 1617)


def test_tile_ownership_and_guard(spark):
    t = tiles.tile_grid(spark, 1024, 1024, 1024, 160).where("row_off = 0").collect()
    assert len(t) == 2
    with pytest.raises(ValueError):
        tiles.tile_grid(spark, 10, 10, 8, 8)


def test_split_shares_nulls_and_empty(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)] + [(None, "b"), (None, None)]
    df = spark.createDataFrame(rows, "k int, g string")
    got = ranking.stratified_split(df, "g", df.k, 0.22).collect()
    assert len(got) == 302
    assert sum(r.test for r in got if r.g == "a") == 44 and sum(r.test for r in got if r.g == "b") == 22
    assert ranking.stratified_split(df.where("false"), "g", df.k, 0.22).count() == 0


def test_rank_is_exact(spark):
    from hashlib import md5

    df = spark.createDataFrame([(i, "a") for i in range(500)], "k int, g string")
    got = {r.k: r["rank"] for r in ranking.hashed_rank(df, "g", df.k, 1).collect()}
    assert got == {k: n for n, k in enumerate(sorted(range(500), key=lambda k: md5(str(k).encode()).hexdigest()), 1)}


def test_marks_reach_all_tiles(spark):
    points = [(1, 0, 0, 3), (2, 127, 127, 4), (3, 64, 64, 5), (4, 300, 10, 2)]
    got = detection.marks_by_tile(spark.createDataFrame(points, "id int, x int, y int, r int"), 128, 256, 256).collect()
    assert sorted((r.id, r.col_off, r.row_off) for r in got) == [(1, 0, 0), (2, 0, 0), (2, 0, 128), (2, 128, 0), (2, 128, 128), (3, 0, 0)]


def test_forest_separates(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(i % 7), float(i % 10 > 6)) for i in range(400)], "id int, a double, b double, y double")
    scored = forest.score(forest.fit(rows, ["a", "b"], "y", trees=10), rows).collect()
    assert all((r.prob > 0.5) == (r.y == 1) for r in scored)
