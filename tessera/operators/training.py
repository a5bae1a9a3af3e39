"""Training rows from candidates and reference points."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import detectors
from tessera.operators.ranking import hashed_rank
from tessera.operators.spatial import nearest_reference

COLUMNS = ("id", "x", "y", "score", "label", "origin")


def _first(df: DataFrame, most) -> DataFrame:
    """The first rows by hash of id, as many as most says (a column)."""
    return hashed_rank(df.withColumn("_all", F.lit(0)), "_all", F.col("id")).where(F.col("rank") <= most).drop("_all", "rank", "many")


def training_set(
    candidates: DataFrame, references: DataFrame, width: int, height: int, near: float, far: float,
    ratio: float = 2.0, anchors: float = 0.08, most_positive: int = 7000, seed: int = 7,
) -> DataFrame:
    """id, x, y, score, label, origin of the rows to learn from. candidates: id, x, y, score; references: id, x, y.

    At most most_positive references take part, chosen by hash. A candidate up to near from one is labelled 1
    ("candidate"), one at far or beyond 0 ("far"); those between are left out. References themselves come in
    as label 1 with score 1 ("anchor"): the share anchors of the positives, all where no candidate is positive.
    Negatives are ratio times the positives at most, chosen by hash; what is missing is filled with places of
    the raster drawn by hash ("random", score 0, negative ids) beyond far, from eight times as many draws: fewer
    rows come where the raster has hardly such places. Rows without coordinates are left out, a null score is 0."""
    placed = "x is not null and y is not null"
    refs = _first(references.where(placed).select("id", "x", "y"), F.lit(most_positive))
    found = nearest_reference(candidates.where(placed).select("id", "x", "y", F.coalesce("score", F.lit(0.0)).alias("score")), refs, far)
    label = F.when(F.col("dist") <= near, 1).when(F.coalesce("dist", F.lit(far)) >= far, 0)
    labelled = found.withColumn("label", label).where("label is not null")
    positive = labelled.where("label = 1").select("id", "x", "y", "score", "label", F.lit("candidate").alias("origin"))
    hits, known = positive.count(), refs.count()  # two numbers
    kept = int(hits * anchors) if hits else known
    anchored = _first(refs, F.lit(kept)).select("id", "x", "y", F.lit(1.0).alias("score"), F.lit(1).alias("label"), F.lit("anchor").alias("origin"))
    wanted = int((hits + min(kept, known)) * ratio)
    negative = _first(labelled.where("label = 0"), F.lit(wanted)).select("id", "x", "y", "score", "label", F.lit("far").alias("origin"))
    missing = wanted - negative.count()
    out = positive.unionByName(anchored).unionByName(negative)
    if missing > 0:
        draw = lambda salt, extent: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(extent)).cast("double")
        places = candidates.sparkSession.range(8 * missing).select((-1 - F.col("id")).alias("id")).withColumns({"x": draw("x", width), "y": draw("y", height)})
        free = nearest_reference(places, refs, far).where(F.coalesce("dist", F.lit(far)) >= far)
        out = out.unionByName(_first(free, F.lit(missing)).select("id", "x", "y", F.lit(0.0).alias("score"), F.lit(0).alias("label"), F.lit("random").alias("origin")))
    return out.select(*COLUMNS)


def raster_rows(
    pixels: DataFrame, width: int, height: int, references: DataFrame, calibration: detectors.Calibration, near: float, far: float, preset: detectors.Preset = detectors.HYBRID, size: int = 512,
    ratio: float = 2.0, anchors: float = 0.08, most_positive: int = 7000, most_tiles: int = 140, seed: int = 7, bands: tuple[str, ...] = ("red", "green", "blue"),
) -> DataFrame:
    """x, y, score, area, radius, features, label, origin: what a forest learns from. references: id, x, y in pixels.

    Windows round at most most_positive references (by hash) are searched with looser limits: candidates up to near from a
    reference are labelled 1 ("candidate"), those at far or beyond 0 ("hard", ratio times most_positive at most). References
    themselves come in as label 1 ("anchor"): the share anchors of the positive candidates, all where there are none. Further
    negatives, ratio times the references, are candidates beyond far of at most most_tiles tiles ("far"), and then places of
    the raster drawn by hash ("random"). An empty reference table gives no rows."""
    from tessera.operators.state import materialize

    refs = materialize(_first(references.where("x is not null and y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), F.lit(most_positive)), "references")
    known = refs.count()
    columns = ["x", "y", "score", "area", "radius", "features", "label", "origin"]
    # How much looser the search round references is, and the further negatives' score.
    loose = replace(preset, share=max(0.40, preset.share - 0.28))
    windows = detectors.corners(refs, width, height, size, calibration.crown)
    found = detectors.propose_in_windows(pixels, windows, width, height, size, loose, calibration, max(0.01, 0.1 * preset.least_score), bands)
    found = materialize(found.withColumn("id", F.monotonically_increasing_id()), "proposed")
    every = references.where("x is not null and y is not null").select("id", "x", "y")
    label = F.when(F.col("dist") <= near, 1).when(F.coalesce("dist", F.lit(far)) >= far, 0)
    labelled = materialize(nearest_reference(found, every, far).withColumn("label", label).where("label is not null"), "labelled")
    positive = labelled.where("label = 1").withColumn("origin", F.lit("candidate")).select(columns)
    hard = _first(labelled.where("label = 0"), F.lit(int(most_positive * ratio))).withColumn("origin", F.lit("hard")).select(columns)
    hits = positive.count()
    at = lambda df, score, origin, label: df.select("id", "x", "y", F.lit(score).alias("score"), F.lit(0.0).alias("area"), F.lit(calibration.crown).alias("radius"), F.lit(label).alias("label"), F.lit(origin).alias("origin"))
    anchored = at(_first(refs, F.lit(min(known, int(hits * anchors)) if hits else known)), 1.0, "anchor", 1)

    wanted = int(known * ratio)
    tiles = [(c * size, r * size) for r in range(-(-height // size)) for c in range(-(-width // size))] if known else []
    tiles = sorted(tiles, key=lambda t: hash((seed, *t)))[:most_tiles]
    grid = pixels.sparkSession.createDataFrame(tiles, "_col int, _row int")
    more = detectors.propose_in_windows(pixels, grid, width, height, size, preset, calibration, 0.75 * preset.least_score, bands).withColumn("id", F.monotonically_increasing_id())
    beyond = nearest_reference(materialize(more.select("id", "x", "y", "score", "area", "radius"), "tiles"), every, far).where(F.col("dist").isNull() | (F.col("dist") >= far))
    beyond = materialize(_first(beyond, F.lit(wanted)).select("id", "x", "y", "score", "area", "radius", F.lit(0).alias("label"), F.lit("far").alias("origin")), "beyond")
    missing = wanted - beyond.count()
    points = anchored.unionByName(beyond)
    if missing > 0:
        draw = lambda salt, extent: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(extent)).cast("double")
        places = pixels.sparkSession.range(8 * missing).withColumns({"x": draw("x", width), "y": draw("y", height)})
        free = nearest_reference(places, every, far).where(F.col("dist").isNull() | (F.col("dist") >= far))
        points = points.unionByName(at(_first(free, F.lit(missing)), 0.0, "random", 0))
    shown = detectors.features_at(pixels, materialize(points, "points"), width, height, size, calibration.crown, bands)
    return positive.unionByName(hard).unionByName(shown.select(columns))
