"""Named queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import spectral as S
from tessera.operators import detectors, ranking, spatial, stats, stencils, tiles
from tessera.plans.fixtures import PTS, PX, REFPTS, SIDE, _read, pts, px, refpts

AFFINE, SIZE = (2.0, 0.0, 10.0, 0.0, -2.0, 500.0), (200, 200)
TURNED = (1.8, 0.6, 10.0, 0.5, -1.9, 500.0)
TILE, OVERLAP, SPACING = 24, 8, 10.0
CALIBRATION_PIXELS = 75.22741532661901


def _r(c, name: str, places: int = 6):
    return F.round(c, places).alias(name)


def _tiled(spark, d):
    return tiles.expand(px(spark, d), SIDE, TILE, OVERLAP)


EX = PX + """, ex as (
  select px.*, cast(ri * 4 + ci as int) as tile_id from px,
    (select unnest(range(4)) ri) a, (select unnest(range(4)) ci) b
  where prow >= ri * 16 and prow < ri * 16 + 24 and pcol >= ci * 16 and pcol < ci * 16 + 24)"""


def _sql_rescale(source: str, name: str, values: dict[str, str], by: str = "tile_id") -> str:
    """A CTE that rescales values of a source by tile."""
    limits = ", ".join(f"quantile_cont(cast({v} as double), 0.02) as lo_{k}, quantile_cont(cast({v} as double), 0.98) as hi_{k}" for k, v in values.items())
    cols = ", ".join(f"case when hi_{k} > lo_{k} then least(greatest((({v}) - lo_{k}) / (hi_{k} - lo_{k}), 0.0), 1.0) else 0.0 end as {k}" for k, v in values.items())
    return f"{name}_l as (select {by}, {limits} from {source} group by {by}), {name} as (select s.*, {cols} from {source} s join {name}_l l using ({by}))"


EXG, GLI, BRIGHT = "(2 * green - red - blue)", "((2 * green - red - blue) / (2 * green + red + blue + 0.000001))", "((red + green + blue) / 3)"
DOM, SAT, NDVI = "(green - greatest(red, blue))", "(greatest(red, green, blue) - least(red, green, blue))", "((nir - red) / (nir + red + 0.000001))"


def _sql_veg(parts: dict[str, tuple[float, str]]) -> str:
    inner = _sql_rescale("ex", "ra", {f"r_{k}": v for k, (_, v) in parts.items()})
    total = " + ".join(f"{w} * r_{k}" for k, (w, _) in parts.items())
    return f"with {EX}, {inner}, {_sql_rescale('ra', 'vg', {'veg': total})}"


VEG_TC = {"exg": (0.50, EXG), "gli": (0.35, GLI), "contrast": (0.15, f"({DOM} - 0.15 * {BRIGHT})")}
VEG_NIR = {"ndvi": (0.75, NDVI), "exg": (0.25, EXG)}
VEG_YC = {"exg": (0.46, EXG), "gli": (0.34, GLI), "dominance": (0.14, DOM), "saturation": (0.06, SAT)}

_Q: dict = {}
_O: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        own = name or f.__name__.removeprefix("q_")
        _Q[own] = f
        if sql:
            _O[own] = sql
        return f

    return add


@query(f"""with {REFPTS}, inb as (select id, wx, wy, (wx - 10) / 2.0 as px, (500 - wy) / 2.0 as py from refpts where wx between 10 and 410 and wy between 100 and 500)
select cast(row_number() over (order by id) as bigint) as id, round(px, 6) as x_pixel, round(py, 6) as y_pixel, 'referencia' as fuente from inb where px >= 0 and px < 200 and py >= 0 and py < 200""")
def q_clip_points(spark, d):
    w, h = SIZE
    left, bottom, right, top = G.bounds(AFFINE, w, h)
    x, y = G.world_to_pixel(F.col("wx"), F.col("wy"), AFFINE)
    p = refpts(spark, d).where(F.col("wx").between(left, right) & F.col("wy").between(bottom, top)).withColumns({"px": x, "py": y}).where((F.col("px") >= 0) & (F.col("px") < w) & (F.col("py") >= 0) & (F.col("py") < h))
    return ranking.sequential_ids(p, "number", "id").select(F.col("number").alias("id"), _r(F.col("px"), "x_pixel"), _r(F.col("py"), "y_pixel"), F.lit("referencia").alias("fuente"))


@query(f"with {REFPTS} select id, round((-1.9 * (wx - 10) - 0.6 * (wy - 500)) / (1.8 * -1.9 - 0.6 * 0.5), 6) as x, round((1.8 * (wy - 500) - 0.5 * (wx - 10)) / (1.8 * -1.9 - 0.6 * 0.5), 6) as y from refpts")
def q_world_to_pixel(spark, d):
    x, y = G.world_to_pixel(F.col("wx"), F.col("wy"), TURNED)
    return refpts(spark, d).select("id", _r(x, "x"), _r(y, "y"))


@query(f"with {PTS} select id, round(1.8::double * (x + 0.5::double) + 0.6::double * (y + 0.5::double) + 10, 6) as wx, round(0.5::double * (x + 0.5::double) - 1.9::double * (y + 0.5::double) + 500, 6) as wy from pts")
def q_pixel_to_world(spark, d):
    x, y = G.pixel_to_world(F.col("x"), F.col("y"), TURNED)
    return pts(spark, d).select("id", _r(x, "wx"), _r(y, "wy"))


@query(f"with {PTS} select cast(row_number() over (order by y, x, id) as bigint) as id, x, y, score from pts")
def q_assign_ids(spark, d):
    return ranking.sequential_ids(pts(spark, d), "number", "y", "x", "id").select(F.col("number").alias("id"), "x", "y", "score")


@query(f"with {PTS} select count(*) as total, cast(count(*) filter (where x < 500 and y < 500) as bigint) as inside, round(avg(score), 6) as mean_score from pts")
def q_run_summary(spark, d):
    return pts(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("x") < 500) & (F.col("y") < 500)).alias("inside"), _r(F.avg("score"), "mean_score"))


@query("""with g as (select cast(a.r as int) ri, cast(b.c as int) ci from (select unnest(range(4)) r) a, (select unnest(range(4)) c) b),
t as (select ri * 4 + ci as tile_id, ci * 16 as col_off, ri * 16 as row_off, least(24, 64 - ci * 16) as w, least(24, 64 - ri * 16) as h from g)
select tile_id, col_off, row_off, w, h, case when col_off > 0 then 4 else 0 end as x0, case when row_off > 0 then 4 else 0 end as y0,
w - case when col_off + w < 64 then 4 else 0 end as x1, h - case when row_off + h < 64 then 4 else 0 end as y1 from t""")
def q_tile_grid(spark, d):
    return tiles.tile_grid(spark, SIDE, SIDE, TILE, OVERLAP)


@query("select * from (values (0, 0, 0, 24, 24), (1, 20, 0, 24, 24), (2, 40, 0, 24, 24), (3, 0, 20, 24, 24), (4, 20, 20, 24, 24)) t(k, col_off, row_off, w, h)")
def q_sample_windows(spark, d):
    return spark.createDataFrame([(k, *w) for k, w in enumerate(tiles.sample_windows(SIDE, SIDE, TILE, 5))], "k int, col_off int, row_off int, w int, h int")


@query(f"with {EX} select tile_id, prow, pcol, red, green, blue, nir from ex")
def q_pixel_tile_expand(spark, d):
    return _tiled(spark, d).select("tile_id", "prow", "pcol", "red", "green", "blue", "nir")


@query(f"with {PX}, g as (select cast(a.r as int) as prow, cast(b.c as int) as pcol from (select unnest(range(24)) r) a, (select unnest(range(24)) c) b) select g.prow, g.pcol, coalesce(red, 0) as red, coalesce(green, 0) as green, coalesce(blue, 0) as blue from g left join px on px.prow = g.prow + 50 and px.pcol = g.pcol - 6")
def q_window_read(spark, d):
    """A window that reaches beyond two edges of the raster."""
    return tiles.read_window(px(spark, d), -6, 50, 24, 24, ["red", "green", "blue"])


@query("select * from (values (0, 14, 14, 36, 36), (1, 0, 0, 36, 36), (2, 30, 0, 36, 36), (3, 0, 30, 36, 36), (4, 30, 30, 36, 36)) t(k, col_off, row_off, w, h)".replace("30", "28"))
def q_sample_windows_yc(spark, d):
    return spark.createDataFrame([(k, *w) for k, w in enumerate(tiles.sample_windows_young(SIDE, SIDE, 36))], "k int, col_off int, row_off int, w int, h int")


@query(f"with {EX} select tile_id, round(quantile_cont(cast(green as double), 0.02), 6) as p2, round(quantile_cont(cast(green as double), 0.62), 6) as p62, round(quantile_cont(cast(green as double), 0.98), 6) as p98 from ex group by 1")
def q_tile_percentiles(spark, d):
    p = stats.percentiles(_tiled(spark, d), "tile_id", F.col("green"), [0.02, 0.62, 0.98], "p")
    return p.select("tile_id", *[_r(F.col("p")[i], n) for i, n in enumerate(("p2", "p62", "p98"))])


@query(f"with {EX} select tile_id, round(median({BRIGHT}), 6) as median_brightness from ex group by 1")
def q_tile_median(spark, d):
    return _tiled(spark, d).groupBy("tile_id").agg(_r(F.median(S.brightness()), "median_brightness"))


@query(f"with {EX}, {_sql_rescale('ex', 'rs', {'v': 'green'})} select tile_id, prow, pcol, round(v, 6) as v from rs")
def q_robust_rescale(spark, d):
    return stats.rescale(_tiled(spark, d), "tile_id", {"v": F.col("green")}).select("tile_id", "prow", "pcol", _r(F.col("v"), "v"))


@query(f"with {PX} select prow, pcol, {EXG} as exg, round({GLI}, 6) as gli, round({BRIGHT}, 6) as brightness, {DOM} as green_dominance, {SAT} as saturation, round(green / (red + blue + 0.000001), 6) as green_ratio from px")
def q_veg_indices(spark, d):
    return px(spark, d).select("prow", "pcol", S.exg().alias("exg"), _r(S.gli(), "gli"), _r(S.brightness(), "brightness"), S.green_dominance().alias("green_dominance"), S.saturation().alias("saturation"), _r(S.green_ratio(), "green_ratio"))


@query(f"with {PX} select prow, pcol, round({NDVI}, 6) as ndvi from px")
def q_ndvi(spark, d):
    return px(spark, d).select("prow", "pcol", _r(S.ndvi(), "ndvi"))


def _veg(f, name):
    def q(spark, d):
        return f(_tiled(spark, d)).select("tile_id", "prow", "pcol", _r(F.col("veg"), "veg", 5))

    _Q[name] = q


for _name, _f, _parts in (("veg_index_tc", stats.veg_index_rgb, VEG_TC), ("veg_index_nir", stats.veg_index_nir, VEG_NIR), ("veg_index_yc", stats.veg_index_young, VEG_YC)):
    _veg(_f, _name)
    _O[_name] = _sql_veg(_parts) + " select tile_id, prow, pcol, round(veg, 5) as veg from vg"


@query(f"with {EX}, {_sql_rescale('ex', 'c1', {'exg': EXG, 'gli': GLI, 'green_dom': DOM, 'r_sat': SAT})}, {_sql_rescale('c1', 'c2', {'veg': '(0.46 * exg + 0.34 * gli + 0.14 * green_dom + 0.06 * r_sat)'})} select tile_id, prow, pcol, red, green, blue, round(exg, 6) as exg, round(gli, 6) as gli, round({BRIGHT}, 6) as brightness, {SAT} as saturation, round(green_dom, 6) as green_dom, round(veg, 5) as veg from c2")
def q_ml_channels(spark, d):
    c = detectors.channels(_tiled(spark, d), "tile_id")
    rounded = {"exg": 6, "gli": 6, "brightness": 6, "green_dom": 6, "veg": 5}
    return c.select("tile_id", "prow", "pcol", "red", "green", "blue", *[_r(F.col(n), n, k) for n, k in rounded.items()], F.col("saturation").cast("int").alias("saturation"))


def _sql_otsu(source: str, v: str) -> str:
    return f"""sp as (select tile_id, cast(min({v}) as double) lo, cast(max({v}) as double) hi from {source} group by 1),
bn as (select e.tile_id, lo, hi, case when hi > lo then least(cast(floor((({v}) - lo) / (hi - lo) * 256) as int), 255) else 0 end as k, count(*) n from {source} e join sp using (tile_id) group by 1, 2, 3, 4),
ce as (select *, lo + (k + 0.5) * (hi - lo) / 256 as c from bn),
cu as (select *, sum(n) over u w1, sum(n * c) over u s1, sum(n) over w w2, sum(n * c) over w s2 from ce window u as (partition by tile_id order by k), w as (partition by tile_id order by k rows between 1 following and unbounded following)),
ga as (select *, round(coalesce(cast(w1 as double) * w2 * pow(s1 / w1 - s2 / w2, 2), 0), 6) gain from cu),
ot as (select tile_id, case when max(hi) > max(lo) then arg_max(c, struct_pack(gain := gain, k := -k)) else max(lo) end as otsu from ga group by 1)"""


@query(f"with {EX}, {_sql_rescale('ex', 'rs', {'v': 'green'})} select tile_id, prow, pcol, cast(trunc(v * 255) as int) as v from rs")
def q_quantise(spark, d):
    """As bytes, the way images are written."""
    return stats.rescale(_tiled(spark, d), "tile_id", {"v": F.col("green")}).select("tile_id", "prow", "pcol", (F.col("v") * 255).cast("int").alias("v"))


@query(f"with {EX}, {_sql_otsu('ex', 'green')} select tile_id, round(otsu, 6) as otsu from ot")
def q_otsu(spark, d):
    return stats.otsu(_tiled(spark, d), "tile_id", "green").select("tile_id", _r(F.col("otsu"), "otsu"))


def _sql_th(parts: dict, share: float, otsu_factor: float, median_factor: float) -> str:
    return _sql_veg(parts) + f""", {_sql_otsu('vg', 'veg')}, th as (select tile_id, greatest(quantile_cont(veg, {share}), max(otsu) * {otsu_factor}) as veg_threshold, least(quantile_cont({BRIGHT}, 0.08), median({BRIGHT}) * {median_factor}) as bright_threshold from vg join ot using (tile_id) group by tile_id)"""


TH = _sql_th(VEG_TC, 0.62, 0.92, 0.55)
_THRESHOLDS = " select tile_id, round(veg_threshold, 5) as veg_threshold, round(bright_threshold, 5) as bright_threshold from th"


def _thresholds(spark, d, preset):
    t = detectors.masks(_tiled(spark, d), "tile_id", preset).groupBy("tile_id").agg(F.max("veg_threshold").alias("v"), F.max("bright_threshold").alias("b"))
    return t.select("tile_id", _r(F.col("v"), "veg_threshold", 5), _r(F.col("b"), "bright_threshold", 5))


for _name, _preset, _parts in (("mask_thresholds", detectors.GENERIC, VEG_TC), ("mask_thresholds_yc", detectors.YOUNG, VEG_YC), ("mask_thresholds_ml", detectors.HYBRID, VEG_YC)):
    _Q[_name] = lambda spark, d, preset=_preset: _thresholds(spark, d, preset)
    _O[_name] = _sql_th(_parts, _preset.share, _preset.otsu_factor, _preset.median_factor) + _THRESHOLDS


@query(TH + f" select tile_id, count(*) as pixels, cast(count(*) filter (where veg >= veg_threshold - 1e-9 and {BRIGHT} >= bright_threshold - 1e-9) as bigint) as crown from vg join th using (tile_id) group by 1")
def q_crown_mask(spark, d):
    m = detectors.masks(_tiled(spark, d), "tile_id", detectors.GENERIC)
    return m.groupBy("tile_id").agg(F.count(F.lit(1)).alias("pixels"), F.count_if("m").alias("crown"))


@query(f"with {PTS} select id, round(abs(atan2(sin(2 * (x / 100.0 - y / 100.0)), cos(2 * (x / 100.0 - y / 100.0)))) / 2, 6) as diff from pts")
def q_angle_diff(spark, d):
    return pts(spark, d).select("id", _r(G.angle_difference(F.col("x") / 100, F.col("y") / 100), "diff"))


PAIRS = f"{PTS}, pr as (select a.id i, b.id j, b.x - a.x dx, b.y - a.y dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) dist from pts a join pts b on a.id <> b.id and abs(a.x - b.x) <= 20 and abs(a.y - b.y) <= 20)"
TH_MOD = "case when atan2(dy, dx) < 0 then atan2(dy, dx) + pi() when atan2(dy, dx) >= pi() then atan2(dy, dx) - pi() else atan2(dy, dx) end"


@query(f"with {PAIRS} select i, j, round({TH_MOD}, 6) as theta from pr where i < j and dist <= 16.5")
def q_pair_angles(spark, d):
    return spatial.range_pairs(pts(spark, d), 16.5).select("i", "j", _r(G.orientation(F.col("dx"), F.col("dy")), "theta"))


@query(f"with {PAIRS} select i, j, dx, dy, round(dist, 6) as dist from pr where i < j and dist <= 10")
def q_range_pairs(spark, d):
    return spatial.range_pairs(pts(spark, d), SPACING).select("i", "j", "dx", "dy", _r(F.col("dist"), "dist"))


@query(f"with {PAIRS} select i, j, round(dist, 6) as dist from pr where dist between 6.2 and 13.8")
def q_annulus_neighbors(spark, d):
    return spatial.annulus(pts(spark, d), 6.2, 13.8).select("i", "j", _r(F.col("dist"), "dist"))


# All pairs, whatever their distance.
NEAREST = f"{PTS}, ne as (select a.id as i, min(struct_pack(d := (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), j := b.id), 6) as best from pts a join pts b on a.id <> b.id group by 1), nn as (select i, unnest(best) as b, unnest(range(1, len(best) + 1)) as rank from ne), k as (select i, b.j as j, sqrt(b.d) as dist, rank from nn)"


@query(f"with {NEAREST} select i, j, round(dist, 6) as dist, cast(rank as int) as rank from k")
def q_knn_self(spark, d):
    return spatial.nearest_within(pts(spark, d), 6, 20.0).select("i", "j", _r(F.col("dist"), "dist"), "rank")


def _halves(spark, d):
    p = pts(spark, d)
    return p.where("id % 2 = 1"), p.where("id % 2 = 0")


@query(f"with {PAIRS}, n as (select i, min(dist) m from pr where i % 2 = 1 and j % 2 = 0 and dist <= 9 group by 1) select id, round(m, 6) as dist from pts left join n on n.i = pts.id where id % 2 = 1")
def q_nearest_ref(spark, d):
    cand, ref = _halves(spark, d)
    return spatial.nearest_reference(cand, ref, 9.0).select("id", _r(F.col("dist"), "dist"))


@query(f"with {PAIRS}, n as (select i, min(dist) m from pr where i % 2 = 1 and j % 2 = 0 and dist <= 9 group by 1), l as (select case when m <= 4 then 1 when coalesce(m, 9) >= 9 then 0 end as label from pts left join n on n.i = pts.id where id % 2 = 1) select label, count(*) as n from l where label is not null group by 1")
def q_label_candidates(spark, d):
    cand, ref = _halves(spark, d)
    label = F.when(F.col("dist") <= 4, 1).when(F.coalesce("dist", F.lit(9.0)) >= 9, 0)
    return spatial.nearest_reference(cand, ref, 9.0).select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {NEAREST} select round(quantile_cont(dist, 0.35), 6) as spacing, count(*) as n from k where dist > 2.4")
def q_spacing_estimate(spark, d):
    k = spatial.nearest_within(pts(spark, d), 6, 20.0).where("dist > 2.4")
    return k.agg(_r(F.percentile("dist", F.lit(0.35)), "spacing"), F.count(F.lit(1)).alias("n"))


@query(f"with {NEAREST} select round(median(dist), 6) as spacing from k where rank = 1")
def q_spacing_median_nn(spark, d):
    return spatial.nearest_within(pts(spark, d), 1, 20.0).agg(_r(F.median("dist"), "spacing"))


@query(f"with {PTS} select tile_id, round(sum((3 + id % 5) * least(greatest(score, 0.05), 1)) / sum(least(greatest(score, 0.05), 1)), 6) as radius from pts group by 1")
def q_weighted_radius(spark, d):
    w = F.least(F.greatest("score", F.lit(0.05)), F.lit(1.0))
    return pts(spark, d).groupBy("tile_id").agg(_r(F.sum((3 + F.col("id") % 5) * w) / F.sum(w), "radius"))


@query(f"with {PAIRS}, k as (select {TH_MOD} as t from pr where i < j and dist <= 16.5 and dist > 5.5 and dist < 15.5), m as (select atan2(avg(sin(2 * t)), avg(cos(2 * t))) / 2 as a, count(*) n from k) select round(case when a < 0 then a + pi() else a end, 5) as angle, n from m")
def q_row_angle_circular(spark, d):
    return spatial.row_angle_circular(spatial.range_pairs(pts(spark, d), 16.5), SPACING).select(_r(F.col("angle"), "angle", 5), "n")


@query(f"with {PAIRS}, k as (select least(cast(floor(({TH_MOD}) / pi() * 36) as int), 35) as k from pr where i < j and dist between 5.5 and 14.5), c as (select k, count(*) n from k group by 1) select round((arg_max(k, struct_pack(n := n, k := -k)) + 0.5) * pi() / 36, 6) as angle, cast(sum(n) as bigint) as n from c")
def q_row_angle_hist(spark, d):
    return spatial.row_angle_histogram(spatial.range_pairs(pts(spark, d), 14.5), SPACING, 0.45).select(_r(F.col("angle"), "angle"), "n")


def _sql_support(tol: float, cross: str = "count(*) filter (where acr and not along)") -> str:
    diff = lambda a: f"abs(atan2(sin(2 * (({TH_MOD}) - {a})), cos(2 * (({TH_MOD}) - {a})))) / 2"
    return f"""with {PAIRS}, s as (select *, {diff('0.3')} <= {tol} as along, {diff('(0.3 + pi() / 2)')} <= {tol} as acr, cos(atan2(dy, dx) - 0.3) * dist >= 0 as ahead from pr where dist between 6.2 and 13.8)
select i as id, count(*) filter (where along and ahead) as forward, count(*) filter (where along and not ahead) as backward, count(*) filter (where acr and not along) as "cross", count(*) filter (where along) + {cross} as support from s group by 1"""


YOUNG_CROSS = "least(count(*) filter (where acr and not along), 1)"
for _name, _tol, _most, _cross in (("row_support_tc", 18.0, None, "count(*) filter (where acr and not along)"), ("row_support_yc", 14.0, 1, YOUNG_CROSS)):
    _Q[_name] = lambda spark, d, tol=math.radians(_tol), most=_most: spatial.row_support(spatial.annulus(pts(spark, d), 6.2, 13.8), 0.3, tol, most)
    _O[_name] = _sql_support(math.radians(_tol), _cross)


@query(f"""with s0 as ({_sql_support(math.radians(18.0))}), {PTS} select pts.id, score, coalesce(support, 0) as support from pts left join s0 on s0.id = pts.id where coalesce(support, 0) >= 1 or score >= 0.58""")
def q_row_filter_tc(spark, d):
    return spatial.row_filter_generic(pts(spark, d), SPACING, 0.3).select("id", "score", "support")


# The row angle comes from the pairs between .55 and 1.45 spacings, as the filter finds it.
_ANGLE = f"""h as (select least(cast(floor(({TH_MOD}) / pi() * 36) as int), 35) as k, count(*) as n from pr where i < j and dist between 5.5 and 14.5 group by 1),
an as (select (arg_max(k, struct_pack(n := n, k := -k)) + 0.5) * pi() / 36 as a from h)"""
_DIFF = f"abs(atan2(sin(2 * (({TH_MOD}) - %s)), cos(2 * (({TH_MOD}) - %s)))) / 2 <= {math.radians(14.0)}"


@query(f"""with {PAIRS}, {_ANGLE}, s as (select i, {_DIFF % ('a', 'a')} as along, {_DIFF % ('(a + pi() / 2)', '(a + pi() / 2)')} as acr, cos(atan2(dy, dx) - a) * dist >= 0 as ahead from pr, an where dist between 5.5 and 14.5),
g as (select i as id, count(*) filter (where along) as r, count(*) filter (where along and ahead) as f, count(*) filter (where along and not ahead) as b, count(*) filter (where acr and not along) as c from s group by 1)
select id, r + least(c, 1) as support from g where (f >= 1 and b >= 1) or (r >= 1 and c >= 1 and r + least(c, 1) >= 2)""")
def q_row_filter_yc(spark, d):
    return spatial.row_filter_young(pts(spark, d), SPACING).select("id", "support")


@query(f"""with {NEAREST}, s as (select median(dist) as s from k where rank = 1) select round(s, 6) as spacing, round(least(greatest(0.25 * s, 4), 40), 6) as crown_radius, round(greatest(2.0, 0.12 * s), 6) as min_radius, round(greatest(6.0, 0.45 * s), 6) as max_radius,
round(s * 0.01999::double, 6) as spacing_m, round({CALIBRATION_PIXELS}::double * 0.12::double, 9) as known_min, round({CALIBRATION_PIXELS}::double * 0.42::double, 9) as known_max from s""")
def q_derive_calibration(spark, d):
    """From the points' own spacing, and from a known one."""
    c, known = detectors.spacing_radii(detectors.reference_spacing(pts(spark, d), 20.0)), detectors.given_spacing(CALIBRATION_PIXELS)
    row = (round(c.spacing, 6), round(c.crown, 6), round(c.least, 6), round(c.most, 6), round(c.spacing * 0.01999, 6), round(known.least, 9), round(known.most, 9))
    return spark.createDataFrame([row], "spacing double, crown_radius double, min_radius double, max_radius double, spacing_m double, known_min double, known_max double")


@query(f"with {PTS}, r as (select *, row_number() over (partition by tile_id, x // 50 order by score desc, id) k from pts) select tile_id, x // 50 as label, id, score from r where k = 1")
def q_best_per_component(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("tile_id", "label").orderBy(F.desc("score"), "id")
    return pts(spark, d).withColumn("label", F.expr("cast(x div 50 as int)")).withColumn("k", F.row_number().over(w)).where("k = 1").select("tile_id", "label", "id", "score")


@query(f"with {PTS}, r as (select *, row_number() over (partition by tile_id order by score desc, id) k from pts) select tile_id, id, score from r where k <= 25")
def q_tile_topk(spark, d):
    from pyspark.sql import Window

    return pts(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("tile_id").orderBy(F.desc("score"), "id"))).where("k <= 25").select("tile_id", "id", "score")


@query()  # SQL would walk through all points one by one: tests hold it against a scan
def q_nms(spark, d):
    """Greedy suppression by score, within 30 pixels."""
    return spatial.suppress(pts(spark, d), 30.0, [(-F.col("score")).alias("s"), F.col("id").alias("k")]).select("id", "x", "y")


@query(f"with {PTS} select count(*) as points, cast(0 as bigint) as conflicts, cast(0 as bigint) as unexplained from pts")
def q_nms_conflicts(spark, d):
    """That the kept points are those of a scan in rank order: no two of them are near each other, and each point that went is
    near a better one that was kept. Only one set of points has both."""
    from tessera.operators.state import materialize

    p = pts(spark, d).select("id", "x", "y", "score")
    marked = p.join(materialize(q_nms(spark, d).select("id", F.lit(1).alias("kept")), "kept"), "id", "left").fillna(0, ["kept"])
    marked = materialize(marked, "marked")
    side = lambda c: marked.select(F.col("id").alias(c), F.col("score").alias(f"s{c}"), F.col("kept").alias(f"k{c}"))
    near = spatial.grid_join(p, p, 30.0).where("i != j and dist < 30").join(side("i"), "i").join(side("j"), "j").where("kj = 1")
    told = near.groupBy("i").agg(F.max("ki").alias("both"), F.max((F.col("sj") > F.col("si")) | ((F.col("sj") == F.col("si")) & (F.col("j") < F.col("i")))).alias("better"))
    out = marked.join(told, marked.id == told.i, "left")
    return out.agg(F.count(F.lit(1)).alias("points"), F.count_if(F.coalesce(F.col("both"), F.lit(0)) == 1).alias("conflicts"), F.count_if((F.col("kept") == 0) & ~F.coalesce("better", F.lit(False))).alias("unexplained"))


@query(f"with {PTS} select id, x, y, score from pts where id % 3 = 0 union all select id, x, y, score from pts where id % 3 > 0")
def q_union_tiles(spark, d):
    p = pts(spark, d).select("id", "x", "y", "score")
    return p.where("id % 3 = 0").unionByName(p.where("id % 3 > 0"))


@query(f"with {PTS} select id, round(least(greatest(sqrt(greatest(x, 1) / pi()) * 0.72, 4), 12), 6) as radius from pts")
def q_crown_radius(spark, d):
    return pts(spark, d).select("id", _r(G.crown_radius(F.col("x"), 0.72, 4, 12, 1), "radius"))


@query(f"with {PTS} select id, x from pts where x between pi() * 25 * 0.18 and pi() * 25 * 4.5")
def q_area_filter(spark, d):
    return pts(spark, d).where(F.col("x").between(math.pi * 25 * 0.18, math.pi * 25 * 4.5)).select("id", "x")


def _mask(spark, d):
    return px(spark, d).select("prow", "pcol", (F.col("red") >= 45).alias("m"))


def _haloed(pixels, halo: int):
    """Tiles of 16 pixels with what their results depend on around them."""
    return tiles.expand_halo(pixels, SIDE, SIDE, 16, halo)


def _tiled_mask(spark, d):
    """The windows of the detectors: components, holes and distances are those of a window."""
    return tiles.expand(_mask(spark, d), SIDE, TILE, OVERLAP)


MASK = PX + ", mk as (select prow, pcol, red >= 45 as m from px)"
TILED = EX + ", mt as (select tile_id, prow, pcol, red >= 45 as m from ex)"
NEAR = "(a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol) <= 1"


def _sql_morph(first: str, second: str) -> str:
    step = lambda src, fold: f"(select a.prow, a.pcol, {fold}(b.m) as m from {src} a join {src} b on abs(a.prow - b.prow) <= 1 and abs(a.pcol - b.pcol) <= 1 and {NEAR} group by 1, 2)"
    return f"with {MASK}, m1 as {step('mk', first)}, m2 as {step('m1', second)} select prow, pcol, m from m2"


@query(_sql_morph("bool_and", "bool_or"))
def q_morph_open(spark, d):
    return stencils.opening(_haloed(_mask(spark, d), 2), "tile_id", "m", 1).where("own").select("prow", "pcol", "m")


@query(_sql_morph("bool_or", "bool_and"))
def q_morph_close(spark, d):
    return stencils.closing(_haloed(_mask(spark, d), 2), "tile_id", "m", 1).where("own").select("prow", "pcol", "m")


LABELS = f"""with recursive {TILED}, c as (select tile_id * 4096 + prow * 64 + pcol as p, prow, pcol, tile_id from mt where m),
e as (select a.p, b.p as q from c a join c b on a.tile_id = b.tile_id and abs(a.prow - b.prow) + abs(a.pcol - b.pcol) = 1),
w as (select p, p as l from c union select e.q, w.l from w join e on e.p = w.p), lb as (select p // 4096 as tile_id, p % 4096 // 64 as prow, p % 64 as pcol, min(l) % 4096 as l from w group by p)"""


@query(LABELS + " select cast(tile_id as int) as tile_id, prow, pcol, l // 64 as label_row, l % 64 as label_col from lb")
def q_connected_components(spark, d):
    c = stencils.label(_tiled_mask(spark, d), "tile_id", "m")
    return c.select("tile_id", "prow", "pcol", F.shiftright("label", 31).cast("int").alias("label_row"), (F.col("label") % (1 << 31)).cast("int").alias("label_col"))


@query(LABELS + " select cast(tile_id as int) as tile_id, l // 64 as label_row, l % 64 as label_col, count(*) as size, round(avg(prow), 6) as row, round(avg(pcol), 6) as col from lb group by tile_id, l")
def q_component_centroids(spark, d):
    c = stencils.label(_tiled_mask(spark, d), "tile_id", "m").groupBy("tile_id", "label").agg(F.count(F.lit(1)).alias("size"), _r(F.avg("prow"), "row"), _r(F.avg("pcol"), "col"))
    return c.select("tile_id", F.shiftright("label", 31).cast("int").alias("label_row"), (F.col("label") % (1 << 31)).cast("int").alias("label_col"), "size", "row", "col")


@query(LABELS + ", s as (select *, count(*) over (partition by tile_id, l) n from lb) select mt.tile_id, mt.prow, mt.pcol, coalesce(n >= 4, false) as m from mt left join s on s.tile_id = mt.tile_id and s.prow = mt.prow and s.pcol = mt.pcol")
def q_drop_small(spark, d):
    return stencils.drop_small(_tiled_mask(spark, d), "tile_id", "m", 4).select("tile_id", "prow", "pcol", "m")


@query(f"with {PX} select a.prow, a.pcol, a.green from px a join px b on abs(a.prow - b.prow) <= 2 and abs(a.pcol - b.pcol) <= 2 group by 1, 2, 3 having a.green = max(b.green) and a.green > 100")
def q_local_maxima(spark, d):
    return stencils.local_maxima(_haloed(px(spark, d), 2), "tile_id", "green", 2, 100).where("own").select("prow", "pcol", "green")


@query(f"with {EX}, t as (select *, max(green) over (partition by tile_id) as top from ex) select a.tile_id, a.prow, a.pcol, a.green from t a join t b on a.tile_id = b.tile_id and abs(a.prow - b.prow) <= 2 and abs(a.pcol - b.pcol) <= 2 group by 1, 2, 3, 4, a.top having a.green = max(b.green) and a.green > greatest(20, 0.25 * a.top)")
def q_peak_floor(spark, d):
    """The floor of peaks rises with the tile's maximum."""
    return stencils.local_maxima(_tiled(spark, d), "tile_id", "green", 2, 20, 0.25).select("tile_id", "prow", "pcol", "green")


@query(f"with {TILED} select a.tile_id, a.prow, a.pcol, case when a.m then round(sqrt(min(case when not b.m then (a.prow - b.prow) * (a.prow - b.prow) + (a.pcol - b.pcol) * (a.pcol - b.pcol) end)), 6) else 0 end as dist from mt a join mt b on a.tile_id = b.tile_id group by a.tile_id, a.prow, a.pcol, a.m")
def q_distance_transform(spark, d):
    return stencils.distance_transform(_tiled_mask(spark, d), "tile_id", "m").select("tile_id", "prow", "pcol", _r(F.col("dist"), "dist"))


def _sql_gauss(sigma: float) -> str:
    reach = int(4 * sigma + 0.5)
    taps = f"tp as (select k, exp(-0.5 * (k / {sigma}) ** 2) / (sum(exp(-0.5 * (k / {sigma}) ** 2)) over ()) as w from (select unnest(range(-{reach}, {reach + 1})) as k))"
    at = lambda c: f"(case when (({c} + k) % 128 + 128) % 128 < 64 then (({c} + k) % 128 + 128) % 128 else 127 - (({c} + k) % 128 + 128) % 128 end)"
    return f"with {PX}, {taps}, g1 as (select a.prow, a.pcol, sum(w * b.green) v from px a, tp, px b where b.prow = a.prow and b.pcol = {at('a.pcol')} group by 1, 2), g2 as (select a.prow, a.pcol, sum(w * b.v) v from g1 a, tp, g1 b where b.pcol = a.pcol and b.prow = {at('a.prow')} group by 1, 2) select prow, pcol, round(v, 5) as v from g2"


@query(_sql_gauss(1.5))
def q_gaussian_blur(spark, d):
    t = _haloed(px(spark, d).select("prow", "pcol", F.col("green").cast("double").alias("v")), 6)
    return stencils.gaussian(t, "tile_id", "v", 1.5).where("own").select("prow", "pcol", _r(F.col("v"), "v", 5))


@query("""with lab as (select l.quality as t, 1 - l.toxic as p from labels l), c as (select unnest([0, 1]) label),
s as (select label, sum(case when t = label and p = label then 1 else 0 end) tp, sum(case when t = label then 1 else 0 end) support, sum(case when p = label then 1 else 0 end) predicted from lab, c group by 1),
m as (select label, coalesce(tp / nullif(predicted, 0), 0) pr, coalesce(tp / nullif(support, 0), 0) re, support from s)
select label, round(pr, 6) as "precision", round(re, 6) as recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) as f1, cast(support as bigint) as support from m""")
def q_classification_report(spark, d):
    lab = _read(spark, d, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p"))
    return stats.classification_report(lab, "t", "p").select("label", _r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"), _r(F.col("f1"), "f1"), "support")


@query("""with lab as (select l.quality as t, 1 - l.toxic as p from labels l), c as (select unnest([0, 1]) label),
s as (select label, sum(case when t = label and p = label then 1 else 0 end) tp, sum(case when t = label then 1 else 0 end) support, sum(case when p = label then 1 else 0 end) predicted from lab, c group by 1),
m as (select support, coalesce(tp / nullif(predicted, 0), 0) pr, coalesce(tp / nullif(support, 0), 0) re from s), f as (select *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) f1 from m)
select round(sum(re * support) / sum(support), 6) as accuracy, round(avg(pr), 6) as macro_precision, round(avg(re), 6) as macro_recall, round(avg(f1), 6) as macro_f1,
round(sum(pr * support) / sum(support), 6) as weighted_precision, round(sum(re * support) / sum(support), 6) as weighted_recall, round(sum(f1 * support) / sum(support), 6) as weighted_f1, cast(sum(support) as bigint) as support from f""")
def q_report_averages(spark, d):
    lab = _read(spark, d, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("p"))
    r = stats.report_averages(stats.classification_report(lab, "t", "p"))
    return r.select(*[_r(F.col(c), c) if c != "support" else F.col(c) for c in r.columns])


@query("select quality as label, count(*) as n, round((select count(*) from labels) / (2.0 * count(*)), 6) as weight from labels group by 1")
def q_class_weights(spark, d):
    lab = _read(spark, d, "labels")
    n = lab.groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("label", "n", _r(F.col("all") / (2 * F.col("n")), "weight"))


@query(f"with {PTS} select id, score from pts where score >= 0.70")
def q_prob_threshold(spark, d):
    return pts(spark, d).where("score >= 0.70").select("id", "score")


@query("""with n as (select n_nationkey as k, (n_nationkey % 5) * 200 as bx, (n_nationkey // 5) * 200 as by_ from nation), """ + PTS + """ select id, x, y from pts where exists (select 1 from n where x >= bx and x < bx + 180 and y >= by_ and y < by_ + 180)""")
def q_aoi_semi_join(spark, d):
    """Boxes are named by the grid cell that holds them, so membership is an equi semi-join."""
    n = _read(spark, d, "nation").select((F.col("n_nationkey") % 5).cast("int").alias("cx"), F.expr("cast(n_nationkey div 5 as int)").alias("cy"))
    p = pts(spark, d).withColumns({"cx": F.expr("cast(x div 200 as int)"), "cy": F.expr("cast(y div 200 as int)")})
    return p.where("x % 200 < 180 and y % 200 < 180").join(n, ["cx", "cy"], "left_semi").select("id", "x", "y")


@query(f"with {PTS} select id, round(2 * (x + 0.5::double) + 10, 3) as x, round(500 - 2 * (y + 0.5::double), 3) as y, round(score, 4) as score from pts")
def q_export_csv(spark, d):
    x, y = G.pixel_to_world(F.col("x"), F.col("y"), AFFINE)
    return pts(spark, d).select("id", _r(x, "x", 3), _r(y, "y", 3), _r(F.col("score"), "score", 4))


@query(f"with {PTS} select id, cast(k as int) as k, round(x + 4 * cos(2 * pi() * k / 24), 6) as x, round(y + 4 * sin(2 * pi() * k / 24), 6) as y from pts, (select unnest(range(25)) k)")
def q_crown_polygons(spark, d):
    p = pts(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(24))))
    turn = 2 * math.pi * F.col("k") / 24
    return p.select("id", "k", _r(F.col("x") + 4 * F.cos(turn), "x"), _r(F.col("y") + 4 * F.sin(turn), "y"))


@query(f"with {PX} select prow // 4 as prow, pcol // 4 as pcol, round(avg(red), 6) as red, round(avg(green), 6) as green, round(avg(blue), 6) as blue from px group by 1, 2")
def q_preview_downsample(spark, d):
    return px(spark, d).groupBy(F.expr("cast(prow div 4 as int)").alias("prow"), F.expr("cast(pcol div 4 as int)").alias("pcol")).agg(*[_r(F.avg(c), c) for c in ("red", "green", "blue")])


@query(f"with {PX} select max(pcol) + 1 as width, max(prow) + 1 as height, 4 as bands, 2.0::double as pixel_size from px")
def q_raster_meta(spark, d):
    return px(spark, d).agg((F.max("pcol") + 1).alias("width"), (F.max("prow") + 1).alias("height")).select("width", "height", F.lit(4).alias("bands"), F.lit(G.pixel_size(AFFINE)).alias("pixel_size"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_O)
