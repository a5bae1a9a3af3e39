"""Queries of the detection steps, with the SQL that checks them; added to the registry on import."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import area, blobs, detection, detectors, forest, ranking, spatial, stats, stencils, tiles, training
from tessera.operators.state import materialize
from tessera.plans.fixtures import ORCHARD, PTS, PX, REFPTS, SIDE, _read, diamonds, orchard, pts, px, refpts
from tessera.plans.registry import AFFINE, BRIGHT, DOM, EX, EXG, GLI, LABELS, MASK, OVERLAP, PAIRS, SAT, TILE, TURNED, _halves, _r, _sql_rescale, _tiled, _tiled_mask, query

CELL = "l // 64 as label_row, l % 64 as label_col"


def _cell(label: str = "label"):
    return F.shiftright(label, 31).cast("int").alias("label_row"), (F.col(label) % (1 << 31)).cast("int").alias("label_col")


@query(LABELS.replace("from mt where m)", "from mt where not m)") + ", s as (select *, count(*) over (partition by tile_id, l) n from lb) select mt.tile_id, mt.prow, mt.pcol, not coalesce(n >= 4, false) as m from mt left join s on s.tile_id = mt.tile_id and s.prow = mt.prow and s.pcol = mt.pcol")
def q_fill_holes(spark, d):
    return stencils.fill_holes(_tiled_mask(spark, d), "tile_id", "m", 4).select("tile_id", "prow", "pcol", "m")


@query(LABELS + f" select cast(tile_id as int) as tile_id, {CELL}, count(*) as size from lb group by tile_id, l")
def q_component_sizes(spark, d):
    return stencils.label(_tiled_mask(spark, d), "tile_id", "m").groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("size")).select("tile_id", *_cell(), "size")


@query(f"with {REFPTS}, p as (select id, (-1.9 * (wx - 10) - 0.6 * (wy - 500)) / (1.8 * -1.9 - 0.6 * 0.5) as x, (1.8 * (wy - 500) - 0.5 * (wx - 10)) / (1.8 * -1.9 - 0.6 * 0.5) as y from refpts) select id, round(x, 6) as x, round(y, 6) as y from p where x >= 0 and x < 200 and y >= 0 and y < 200")
def q_reference_pixels(spark, d):
    x, y = G.world_to_pixel(F.col("wx"), F.col("wy"), TURNED)
    p = refpts(spark, d).select("id", x.alias("x"), y.alias("y"))
    return p.where("x >= 0 and x < 200 and y >= 0 and y < 200").select("id", _r(F.col("x"), "x"), _r(F.col("y"), "y"))


@query(f"""with {EX}, o as (select *, (tile_id % 4) * 16 as co, (tile_id // 4) * 16 as ro from ex), b as (select *, least(24, 64 - co) as w, least(24, 64 - ro) as h from o)
select tile_id, prow, pcol from b where pcol - co >= case when co > 0 then 4 else 0 end and prow - ro >= case when ro > 0 then 4 else 0 end
and pcol - co < w - case when co + w < 64 then 4 else 0 end and prow - ro < h - case when ro + h < 64 then 4 else 0 end""")
def q_valid_box_filter(spark, d):
    t = tiles.tile_grid(spark, SIDE, SIDE, TILE, OVERLAP)
    own = F.expr("pcol - col_off >= x0 and pcol - col_off < x1 and prow - row_off >= y0 and prow - row_off < y1")
    return _tiled(spark, d).join(t, "tile_id").where(own).select("tile_id", "prow", "pcol")


@query("""with n as (select (n_nationkey % 5) * 200 as bx, (n_nationkey // 5) * 200 as by_ from nation where n_nationkey % 3 = 0),
t as (select r.i * 13 + c.i as tile_id, c.i * 80 as co, r.i * 80 as ro, least(96, 1024 - c.i * 80) as w, least(96, 1024 - r.i * 80) as h from (select unnest(range(13)) i) r, (select unnest(range(13)) i) c)
select cast(tile_id as int) as tile_id from t where exists (select 1 from n where co < bx + 180 and co + w > bx and ro < by_ + 180 and ro + h > by_)""")
def q_aoi_tile_prune(spark, d):
    """Tiles that some box of the area meets: an equi semi-join on the cells a tile covers."""
    boxes = _read(spark, d, "nation").where("n_nationkey % 3 = 0").select((F.col("n_nationkey") % 5).cast("int").alias("cx"), F.expr("cast(n_nationkey div 5 as int)").alias("cy"))
    cells = lambda o, e: F.explode(F.sequence(F.floor(F.col(o) / 200).cast("int"), F.floor((F.col(o) + F.col(e) - 1) / 200).cast("int")))
    t = tiles.tile_grid(spark, 1024, 1024, 96, 16).withColumn("cx", cells("col_off", "w")).withColumn("cy", cells("row_off", "h"))
    met = t.where("col_off < cx * 200 + 180 and col_off + w > cx * 200 and row_off < cy * 200 + 180 and row_off + h > cy * 200")
    return met.join(boxes, ["cx", "cy"], "left_semi").select(F.col("tile_id").cast("int")).distinct()


@query(f"with {PTS}, q as (select tile_id, greatest(0.08, quantile_cont(score, 0.45)) as floor_ from pts group by 1) select id, score from pts join q using (tile_id) where score >= floor_ - 1e-9")
def q_blob_keep(spark, d):
    p = pts(spark, d)
    q = stats.percentiles(p, "tile_id", F.col("score"), [0.45], "q").select("tile_id", F.greatest(F.lit(0.08), F.col("q")[0]).alias("floor_"))
    return p.join(q, "tile_id").where("score >= floor_ - 1e-9").select("id", "score")


# Components of the orchard's crowns; the largest kind is beyond the range.
PLANTED = f"""with recursive {ORCHARD}, mt as (select prow // 48 * 3 + pcol // 48 as tile_id, prow, pcol, green >= 100 as m from orchard), c as (select tile_id * 16384 + prow * 128 + pcol as p, prow, pcol, tile_id from mt where m),
e as (select a.p, b.p as q from c a join c b on a.tile_id = b.tile_id and abs(a.prow - b.prow) + abs(a.pcol - b.pcol) = 1),
w as (select p, p as l from c union select e.q, w.l from w join e on e.p = w.p), lb as (select p // 16384 as tile_id, p % 16384 // 128 as prow, p % 128 as pcol, min(l) as l from w group by p)"""
_COMPONENTS = "cc as (select avg(pcol) as x, avg(prow) as y, sqrt(count(*) / pi()) * 0.72 as radius, 0.65::double as score from lb group by l having count(*) between 20 and greatest(80, pi() * 23.04))"
_PEAKS = "pk as (select a.tile_id, a.prow, a.pcol, a.green from ex a join ex b on a.tile_id = b.tile_id and abs(a.prow - b.prow) <= 2 and abs(a.pcol - b.pcol) <= 2 group by 1, 2, 3, 4 having a.green = max(b.green) and a.green > 100)"
LOOSE = LABELS.replace("red >= 45 as m", "red >= 15 as m")


def _loose(spark, d):
    return tiles.expand(px(spark, d).select("prow", "pcol", (F.col("red") >= 15).alias("m")), SIDE, TILE, OVERLAP)


def _components(spark, d):
    crowns = tiles.expand(orchard(spark, d).select("prow", "pcol", (F.col("green") >= 100).alias("m")), 120, 48, 0)
    return detection.component_candidates(crowns, "tile_id", "m", 20, max(80, math.pi * 4.8**2)).select(*[_r(F.col(c), c) for c in ("x", "y", "radius", "score")])


def _peaks(spark, d):
    return stencils.local_maxima(_tiled(spark, d), "tile_id", "green", 2, 100).select("tile_id", "prow", "pcol", "green")


@query(f"{PLANTED}, {_COMPONENTS} select round(x, 6) as x, round(y, 6) as y, round(radius, 6) as radius, score from cc")
def q_calib_candidates(spark, d):
    return _components(spark, d)


@query(f"{PLANTED}, {EX}, {_COMPONENTS}, {_PEAKS} select round(x, 6) as x, round(y, 6) as y, round(radius, 6) as radius, score from cc union all select pcol, prow, round(2 * sqrt(2.0::double), 6), round(green / 255.0::double, 6) from pk")
def q_calib_union(spark, d):
    blobs = _peaks(spark, d).select(F.col("pcol").cast("double").alias("x"), F.col("prow").cast("double").alias("y"), F.lit(round(2 * math.sqrt(2.0), 6)).alias("radius"), _r(F.col("green") / 255.0, "score"))
    return _components(spark, d).unionByName(blobs)


@query(f"{LOOSE}, {_PEAKS}, z as (select tile_id, l, count(*) as size from lb group by 1, 2) select pk.tile_id, pk.prow, pk.pcol, {CELL}, size from pk join lb on lb.tile_id = pk.tile_id and lb.prow = pk.prow and lb.pcol = pk.pcol join z on z.tile_id = lb.tile_id and z.l = lb.l".replace("l // 64", "lb.l // 64").replace("l % 64 as", "lb.l % 64 as"))
def q_peak_component_join(spark, d):
    found = detection.peaks_in_components(_peaks(spark, d), stencils.label(_loose(spark, d), "tile_id", "m"), "tile_id")
    return found.select("tile_id", "prow", "pcol", *_cell(), "size")


@query(f"with {PTS}, r as (select *, row_number() over (partition by tile_id, id % 2 order by score desc, id) k from pts) select tile_id, id from r where k <= 12")
def q_caps(spark, d):
    p = pts(spark, d).withColumn("kind", F.col("id") % 2)
    from pyspark.sql import Window

    return p.withColumn("k", F.row_number().over(Window.partitionBy("tile_id", "kind").orderBy(F.desc("score"), "id"))).where("k <= 12").select("tile_id", "id")


@query("""with e as (select vec_id, unnest(embedding) :: double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
f as (select *, (pos // 8 between 2 and 5) and (pos % 8 between 2 and 5) as inn from e)
select vec_id, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std, round(quantile_cont(v, 0.25), 5) as p25, round(quantile_cont(v, 0.75), 5) as p75,
round(max(case when pos = 36 then v end), 5) as center, round(avg(case when inn then v end) - avg(v), 5) as contrast from f group by 1""")
def q_patch_features(spark, d):
    f = detection.patch_features(_read(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    return f.select("vec_id", *[_r(F.col(c), c, 5) for c in ("mean", "std", "p25", "p75", "center", "contrast")])


@query(f"with {PTS} select x // 64 * 64 as col_off, y // 64 * 64 as row_off, min(id) as id from pts group by 1, 2")
def q_distinct_windows(spark, d):
    return pts(spark, d).groupBy(F.expr("cast(x div 64 * 64 as int)").alias("col_off"), F.expr("cast(y div 64 * 64 as int)").alias("row_off")).agg(F.min("id").alias("id"))


@query()  # as nms
def q_nms_thin(spark, d):
    """Thinning by 1.65 median radii before spacing is estimated; equal scores, so by id."""
    p = pts(spark, d)
    radius = p.agg(F.median(3 + F.col("id") % 5)).first()[0] or 0.0
    return spatial.suppress(p, max(3.0, 1.65 * radius), [F.col("id").alias("k")]).select("id", "x", "y")


@query(f"""with {PAIRS}, n as (select i, min(dist) m from pr where i % 2 = 1 and j % 2 = 0 and dist <= 9 group by 1),
l as (select id, case when m <= 4 then 1 when coalesce(m, 9) >= 9 then 0 end as label from pts left join n on n.i = pts.id where id % 2 = 1)
select id, label, 'candidate' as origin from l where label is not null union all select id, 1, 'anchor' from pts where id % 2 = 0""")
def q_training_union(spark, d):
    cand, ref = _halves(spark, d)
    label = F.when(F.col("dist") <= 4, 1).when(F.coalesce("dist", F.lit(9.0)) >= 9, 0)
    rows = spatial.nearest_reference(cand, ref, 9.0).select("id", label.alias("label"), F.lit("candidate").alias("origin")).where("label is not null")
    return rows.unionByName(ref.select("id", F.lit(1).alias("label"), F.lit("anchor").alias("origin")))


def _sql_blur(source: str, v: str, sigma: float, name: str) -> str:
    """CTEs that blur v of source (prow, pcol) as name."""
    reach = int(4 * sigma + 0.5)
    at = lambda c: f"(case when (({c} + k) % 128 + 128) % 128 < 64 then (({c} + k) % 128 + 128) % 128 else 127 - (({c} + k) % 128 + 128) % 128 end)"
    return f"""{name}_t as (select k, exp(-0.5 * (k / {sigma}) ** 2) / (sum(exp(-0.5 * (k / {sigma}) ** 2)) over ()) as w from (select unnest(range(-{reach}, {reach + 1})) as k)),
{name}_1 as (select a.prow, a.pcol, sum(w * b.{v}) v from {source} a, {name}_t, {source} b where b.prow = a.prow and b.pcol = {at('a.pcol')} group by 1, 2),
{name} as (select a.prow, a.pcol, sum(w * b.v) v from {name}_1 a, {name}_t, {name}_1 b where b.pcol = a.pcol and b.prow = {at('a.prow')} group by 1, 2)"""


_DIST = "ds as (select a.prow, a.pcol, case when a.m then coalesce(sqrt(min(case when not b.m then (a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol) end)), 0) else 0 end as v from mk a, mk b group by a.prow, a.pcol, a.m)"


@query(f"""with {MASK}, {_DIST}, {_sql_blur('px', 'green', 1.0, 'bs')}, {_sql_blur('px', 'green', 3.0, 'bl')}, {_sql_blur('ds', 'v', 0.6, 'bd')},
j as (select 0 as tile_id, prow, pcol, m, case when m then bs.v - bl.v else 0 end as df, bd.v as dd from mk join bs using (prow, pcol) join bl using (prow, pcol) join bd using (prow, pcol)),
{_sql_rescale('j', 'k1', {'a': 'df', 'b': 'dd'})}, {_sql_rescale('k1', 'k2', {'response': '(case when m then 0.72 * a + 0.28 * b else 0 end)'})}
select prow, pcol, m, round(response, 4) as response from k2""")
def q_response_image(spark, d):
    p = px(spark, d).select(F.lit(0).alias("tile_id"), "prow", "pcol", "green", (F.col("red") >= 45).alias("m"))
    return detection.response_image(p, "tile_id", "green", "m", 1.0, 3.0, 0.6).select("prow", "pcol", "m", _r(F.col("response"), "response", 4))


@query("with r as (select doc_id, quality as label, row_number() over (partition by quality order by md5(cast(doc_id as varchar)), doc_id) k, count(*) over (partition by quality) n from labels) select doc_id, label, k <= round(0.22 * n) as test from r")
def q_stratified_split(spark, d):
    return ranking.stratified_split(_read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "label", F.col("doc_id"), 0.22)


@query(f"with {PTS}, p as (select id, x, y, 3 + id % 5 as r from pts), c as (select unnest(range(0, (select max(x) // 128 + 2 from pts))) i) select id, a.i * 128 as col_off, b.i * 128 as row_off, x - a.i * 128 as cx, y - b.i * 128 as cy, r from p join c a on x + r >= a.i * 128 and x - r < (a.i + 1) * 128 join c b on b.i < 8 and y + r >= b.i * 128 and y - r < (b.i + 1) * 128")
def q_tile_marks(spark, d):
    return detection.marks_by_tile(pts(spark, d).select("id", "x", "y", (3 + F.col("id") % 5).alias("r")), 128, 1 << 30, 1024)


@query(f"with {PTS} select id, cast(round_even(x * 0.5, 0) as int) as cx, cast(round_even(y * 0.5, 0) as int) as cy, cast(greatest(2, round_even(greatest(3 + id % 5, 0.65 * 7) * 0.5, 0)) as int) as r from pts")
def q_preview_marks(spark, d):
    half = lambda c: F.bround(c * 0.5).cast("int")
    return pts(spark, d).select("id", half(F.col("x")).alias("cx"), half(F.col("y")).alias("cy"), F.greatest(F.lit(2), half(F.greatest((3 + F.col("id") % 5).cast("double"), F.lit(0.65 * 7)))).alias("r"))


@query(f"with {PTS} select id, cast(json_object('type', 'Feature', 'properties', json_object('id', id, 'score', score), 'geometry', json_object('type', 'Point', 'coordinates', json_array(2 * (x + 0.5::double) + 10, 500 - 2 * (y + 0.5::double)))) as varchar) as feature from pts")
def q_geojson_points(spark, d):
    x, y = G.pixel_to_world(F.col("x"), F.col("y"), AFFINE)
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return pts(spark, d).select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("id", "score").alias("properties"), geometry.alias("geometry"))).alias("feature"))


FEATURES = ["mean", "std", "p25", "p75", "center", "contrast"]


def _rows(spark, d):
    return detection.patch_features(_read(spark, d, "embeddings"), "embedding", 8).withColumn("y", (F.col("label") % 2).cast("double"))


@query()
def q_forest_fit(spark, d):
    model = forest.fit(_rows(spark, d), FEATURES, "y", trees=20).stages[-1]
    return spark.createDataFrame([(n, float(v)) for n, v in zip(FEATURES, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


@query()
def q_forest_score(spark, d):
    rows = _rows(spark, d)
    return forest.score(forest.fit(rows, FEATURES, "y", trees=20), rows).select("vec_id", "y", "prob")


@query()
def q_log_blobs(spark, d):
    tile = px(spark, d).withColumns({"tile_id": F.lit(0), "v": F.when(F.col("red") >= 20, F.col("green") / 255.0).otherwise(0.0)})
    return blobs.log_blobs(tile, "tile_id", "v", blobs.scales(2.0, 8.0)).select("prow", "pcol", _r(F.col("radius"), "radius"), _r(F.col("response"), "response"))


@query()
def q_training_set(spark, d):
    cand, ref = _halves(spark, d)
    return training.training_set(cand.select("id", "x", "y", (F.col("id") % 10 / 10).alias("score")), ref, 1009, 1013, 4.0, 9.0)


#: What is known of the orchard's crowns.
KNOWN = detectors.Calibration(crown=4.0, least=2.5, most=6.0, spacing=24.0)
PRESETS = {"generic": detectors.GENERIC, "young": detectors.YOUNG, "hybrid": detectors.HYBRID}


def _detected(spark, d, preset, **how):
    small = replace(preset, tile=72, overlap=24, share=0.9)
    found = detectors.detect(orchard(spark, d), 120, 120, small, KNOWN, **how).withColumn("id", F.monotonically_increasing_id())
    return spatial.suppress(materialize(found, "found"), min(0.72 * KNOWN.spacing, 2.2 * KNOWN.crown), [(-F.col("score")).alias("s"), F.col("y").alias("y"), F.col("x").alias("x"), F.col("id").alias("k")])


def _by_plot(found):
    """Detections by the plot whose crown they lie in; any other has plot -1."""
    plot = (F.floor(F.col("y") / 24) * 5 + F.floor(F.col("x") / 24)).cast("int")
    near = F.hypot(F.col("x") % 24 - 12, F.col("y") % 24 - 12) <= 3 + plot % 3
    return found.groupBy(F.when(near, plot).otherwise(-1).alias("plot")).agg(F.count(F.lit(1)).alias("found"))


for _name, _preset in PRESETS.items():
    # One candidate for each planted crown, and none elsewhere.
    query("select cast(n_nationkey as int) as plot, cast(1 as bigint) as found from nation", f"propose_{_name}")(lambda spark, d, preset=_preset: _by_plot(_detected(spark, d, preset)))


@query("select cast(n_nationkey as int) as plot, cast(1 as bigint) as found from nation where n_nationkey % 3 > 0")
def q_propose_in_area(spark, d):
    return _by_plot(_detected(spark, d, detectors.HYBRID, area=diamonds(spark, d, 24, 8.4, "n_nationkey % 3 > 0")))


@query("""with d as (select cast(n_nationkey as int) as k, n_nationkey % 5 * 24 + 12 as cx, n_nationkey // 5 * 24 + 12 as cy from nation where n_nationkey % 3 = 0),
g as (select cast(a.r as int) as prow, cast(b.c as int) as pcol from (select unnest(range(120)) r) a, (select unnest(range(120)) c) b)
select distinct prow, pcol from g, d where greatest(0, pcol - cx, cx - pcol - 1) + greatest(0, prow - cy, cy - prow - 1) <= 8.4""")
def q_area_raster(spark, d):
    """Every pixel that an area touches."""
    return detectors.area_pixels(diamonds(spark, d, 24, 8.4), 120, 120, 48)


@query(f"with {PTS}, d as (select n_nationkey % 5 * 200 + 100 as cx, n_nationkey // 5 * 200 + 100 as cy from nation where n_nationkey % 3 = 0) select id, x, y from pts where exists (select 1 from d where abs(x - cx) + abs(y - cy) < 90.5)")
def q_area_points(spark, d):
    return area.points_inside(pts(spark, d).select("id", "x", "y"), diamonds(spark, d, 200, 90.5), 50.0)


_STATS = {"mean": "avg({c})", "std": "stddev_pop({c})", "p25": "quantile_cont(cast({c} as double), 0.25)", "p75": "quantile_cont(cast({c} as double), 0.75)", "center": "max(case when prow = cy and pcol = cx then {c} end)"}
_NINE = f"""with {EX}, {_sql_rescale('ex', 'c1', {'exg': EXG, 'gli': GLI, 'green_dom': DOM, 'r_sat': SAT})}, {_sql_rescale('c1', 'c2', {'veg': '(0.46 * exg + 0.34 * gli + 0.14 * green_dom + 0.06 * r_sat)'})},
nine as (select tile_id, prow, pcol, red, green, blue, exg, gli, {BRIGHT} as brightness, {SAT} as saturation, green_dom, veg, tile_id % 4 * 16 + 16 as cx, tile_id // 4 * 16 + 16 as cy from c2 where tile_id % 4 < 3 and tile_id // 4 < 3)"""


@query(
    _NINE + " select cast(tile_id as bigint) as id, " + ", ".join(f"round({f.format(c=c)}, 5) as {c}_{n}" for c in detectors.CHANNELS for n, f in _STATS.items())
    + ", round(avg(veg) filter (where abs(prow - cy) <= 2 and abs(pcol - cx) <= 2) - avg(veg), 5) as local_contrast, round(max(case when prow = cy and pcol = cx then green / (red + blue + 0.000001) end), 5) as green_ratio from nine where abs(prow - cy) <= 4 and abs(pcol - cx) <= 4 group by 1"
)
def q_candidate_features(spark, d):
    """The fifty features of nine places, but for the three that come with the candidate."""
    at = spark.createDataFrame([(r * 4 + c, c * 16.0 + 16, r * 16.0 + 16, 0.5, 30.0, 4.0) for r in range(3) for c in range(3)], "id long, x double, y double, score double, area double, radius double")
    got = detectors.features_at(px(spark, d), at, SIDE, SIDE, TILE, 4.0, scaled=False)
    return got.select("id", *[_r(F.col("features")[k], n, 5) for k, n in enumerate(detectors.FEATURES) if n not in ("score", "area_px", "radius_px")])


@query(f"with {ORCHARD}, p as (select cast(n_nationkey as int) as id, n_nationkey % 5 * 24 + 12.5::double as x, n_nationkey // 5 * 24 + 13.5::double as y, 0 as tile_id from nation) select id, x, y, green from p join orchard on prow = cast(round_even(y, 0) as int) and pcol = cast(round_even(x, 0) as int)")
def q_gather_at(spark, d):
    """The value of the pixel at each place, halves to the even one."""
    n = _read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("id"), (F.col("n_nationkey") % 5 * 24 + 12.5).cast("double").alias("x"), (F.floor(F.col("n_nationkey") / 5) * 24 + 13.5).cast("double").alias("y"), F.lit(0).alias("tile_id"))
    return detection.gather_at(n, orchard(spark, d).withColumn("tile_id", F.lit(0)), "tile_id", "green").select("id", "x", "y", "green")


@query("select round(24.0::double, 6) as spacing, true as crown_in_range, true as thresholds_in_range")
def q_calibrate_generic(spark, d):
    """The orchard's spacing, found from its crowns."""
    c = detectors.calibrate_generic(spark, orchard(spark, d), 120, 120, least=3.0, most=6.0, windows=1, preset=replace(detectors.GENERIC, tile=120, share=0.9))
    return spark.createDataFrame([(round(c.spacing, 6), 3.0 <= c.crown <= 6.0, 0.0 < c.veg < 1.0 and 0.0 <= c.bright < 1.0)], "spacing double, crown_in_range boolean, thresholds_in_range boolean")


@query("select 24.0::double as spacing, 6.0::double as crown, 2.88::double as least, 10.08::double as most, true as thresholds_in_range")
def q_calibrate_young(spark, d):
    c = detectors.calibrate_young(spark, orchard(spark, d), 120, 120, 24.0, preset=replace(detectors.YOUNG, tile=72))
    return spark.createDataFrame([(c.spacing, round(c.crown, 6), round(c.least, 6), round(c.most, 6), 0.0 < c.veg < 1.0 and 0.0 <= c.bright < 1.0)], "spacing double, crown double, least double, most double, thresholds_in_range boolean")
