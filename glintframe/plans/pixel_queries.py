"""Queries on pixels: masks, retrieval, neighbourhoods, plumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PlumeThresholds
from ..functions import scalars as X
from ..operators import masks as M
from ..operators import neighbour as N
from ..operators import plumes as G
from ..operators import retrieval as R
from ..operators import timeline as T_
from ..operators.timeline import zonal
from .adapters import view
from .catalog import DX, DY, SGI, SGIC, TAI, WATER, query, r6

USABLE = f"coalesce(b11 IS NOT NULL AND b12 IS NOT NULL AND b11 < 10000 AND b12 < 10000 AND {WATER}, false)"


def usable() -> Column:
    return M.composite({"data": M.data_ok(), "saturation": M.unsaturated(), "water": M.water()})


def px(spark, d) -> DataFrame:
    return view(spark, d, "px")


def counted(df: DataFrame, mask: Column) -> DataFrame:
    """sid, n_on, n_off, n_null of a mask."""
    return df.groupBy("sid").agg(F.count_if(mask).alias("n_on"), F.count_if(~mask).alias("n_off"), F.count_if(mask.isNull()).alias("n_null"))


def counted_sql(mask: str) -> str:
    return f"SELECT sid, count_if({mask}) AS n_on, count_if(NOT ({mask})) AS n_off, count_if(({mask}) IS NULL) AS n_null FROM px GROUP BY sid"


@query("mbsp_scene_summary", f"""
SELECT sid, round(any_value(c), 6) AS c_factor, round(avg(CASE WHEN ok AND b11 <> 0 THEN (c * b12 - b11) / b11 END), 6) AS mean_mbsp, count_if(ok) AS n_valid
FROM (SELECT *, sum(CASE WHEN ok THEN b11 * b12 END) OVER (PARTITION BY sid) / sum(CASE WHEN ok THEN b12 * b12 END) OVER (PARTITION BY sid) AS c
      FROM (SELECT *, {USABLE} AS ok FROM px)) GROUP BY sid""", "px")
def mbsp_scene_summary(spark, d):
    p = px(spark, d).withColumn("ok", usable())
    p = R.retrieval(p, F.col("ok"), F.col("ok"))
    return p.groupBy("sid").agg(r6(F.max("c")).alias("c_factor"), r6(F.avg("r")).alias("mean_mbsp"), F.count_if("ok").alias("n_valid"))


@query("c_factor", f"SELECT sid, round(sum(b11 * b12) FILTER ({USABLE}) / sum(b12 * b12) FILTER ({USABLE}), 6) AS c FROM px GROUP BY sid", "px")
def c_factor(spark, d):
    return R.scene_factors(px(spark, d), usable()).select("sid", r6("c").alias("c"))


@query("mbsp_ratio", """
SELECT sid, "row" AS grid_row, col AS grid_col, round(CASE WHEN b11 <> 0 THEN (c * b12 - b11) / b11 END, 6) AS r
FROM (SELECT *, sum(b11 * b12) OVER (PARTITION BY sid) / sum(CASE WHEN b11 IS NOT NULL THEN b12 * b12 END) OVER (PARTITION BY sid) AS c FROM px)""", "px")
def mbsp_ratio(spark, d):
    return R.fractional_absorption(px(spark, d)).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), r6("r").alias("r"))


@query("retrieval_split_masks", f"""
SELECT sid, round(any_value(c), 6) AS c, count(r) AS n_r, round(sum(r), 5) AS sum_r FROM (
  SELECT *, CASE WHEN b11 IS NOT NULL AND {WATER} AND b11 <> 0 THEN (c * b12 - b11) / b11 END AS r FROM (
    SELECT *, sum(CASE WHEN {USABLE} THEN b11 * b12 END) OVER (PARTITION BY sid) / sum(CASE WHEN {USABLE} THEN b12 * b12 END) OVER (PARTITION BY sid) AS c FROM px)) GROUP BY sid""", "px")
def retrieval_split_masks(spark, d):
    p = R.retrieval(px(spark, d), usable(), F.col("b11").isNotNull() & M.water())
    return p.groupBy("sid").agg(r6(F.max("c")).alias("c"), F.count("r").alias("n_r"), F.round(F.sum("r"), 5).alias("sum_r"))


@query("radius_mask", f"""
SELECT sid, count_if({DX} * {DX} + {DY} * {DY} <= 40000E0) AS n_inside, count_if({DX} * {DX} + {DY} * {DY} > 40000E0) AS n_outside FROM px GROUP BY sid""", "px")
def radius_mask(spark, d):
    at = ("lon", "lat", "site_lon", "site_lat", 200.0)
    return px(spark, d).groupBy("sid").agg(F.count_if(M.radius(*at)).alias("n_inside"), F.count_if(M.radius(*at, inside=False)).alias("n_outside"))


@query("metre_offsets", f"SELECT sid, \"row\" AS grid_row, col AS grid_col, round({DX}, 4) AS dx, round({DY}, 4) AS dy FROM px", "px")
def metre_offsets(spark, d):
    dx, dy = X.metre_offsets("lon", "lat", "site_lon", "site_lat")
    return px(spark, d).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy"))


for _name, _mask, _sql in (
    ("saturation_mask", M.unsaturated, "b11 < 10000 AND b12 < 10000"),
    ("ndwi_mask", M.water, WATER),
    ("sga_mask", M.glint_local, "sga < 30"),
    ("sgi_mask", lambda: M.glint_indexed(X.glint_index("b12", X.visible("b2", "b3", "b4"))), f"({SGI}) > -0.3E0"),
    ("qa60_clear", M.qa60_clear, "(qa60 & 3072) = 0"),
    ("flare_mask_review", M.flare_review, f"({TAI}) >= 0.45E0 AND (b12 - b11) >= (b11 - b8a) AND b12 >= 1500"),
    ("flare_mask_viewer", M.flare_viewer, f"({TAI}) >= 0.15E0"),
    ("data_ok_mask", M.data_ok, "b11 IS NOT NULL AND b12 IS NOT NULL"),
    ("any_band_mask", lambda: M.any_band(["b11", "b12", "cs_cdf"]), "coalesce(b11, b12, cs_cdf) IS NOT NULL"),
    ("sga_window_mask", lambda: (F.col("sga") > 5.0) & (F.col("sga") < 35.0), "sga > 5 AND sga < 35"),
):
    query(_name, counted_sql(_sql), "px")(lambda spark, d, mask=_mask: counted(px(spark, d), mask()))


TIERS = "SELECT sid, bool_or(cs_cdf IS NOT NULL) AS has_cs, bool_or(probability IS NOT NULL) AS has_probability FROM px GROUP BY sid"
CLOUD = "CASE WHEN has_cs THEN cs_cdf >= 0.65E0 WHEN has_probability THEN probability < 65 ELSE true END"


def tiered(p: DataFrame) -> DataFrame:
    return p.join(M.scene_cloud_tiers(p), "sid")


@query("cloud_tables_join", f"WITH tiers AS ({TIERS}) SELECT sid, count(*) AS n, count(cs_cdf) AS n_scored, count(probability) AS n_probable, count_if({CLOUD}) AS n_on FROM px JOIN tiers USING (sid) GROUP BY sid", "px")
def cloud_tables_join(spark, d):
    """Bands, cloud scores and cloud probabilities as three tables, met pixel by pixel."""
    p = px(spark, d)
    scores, probabilities = (p.where(F.col(c).isNotNull()).select("sid", "row", "col", c) for c in ("cs_cdf", "probability"))
    met = tiered(M.with_clouds(p.drop("cs_cdf", "probability"), scores, probabilities))
    return met.groupBy("sid").agg(F.count("*").alias("n"), F.count("cs_cdf").alias("n_scored"), F.count("probability").alias("n_probable"), F.count_if(M.cloud_free()).alias("n_on"))


@query("cloud_tier", f"WITH tiers AS ({TIERS}) SELECT sid, count_if({CLOUD}) AS n_on, count_if(NOT {CLOUD}) AS n_off, count_if(({CLOUD}) IS NULL) AS n_null FROM px JOIN tiers USING (sid) GROUP BY sid", "px")
def cloud_tier(spark, d):
    return counted(tiered(px(spark, d)), M.cloud_free())


WIND = "CASE WHEN u IS NULL THEN NULL ELSE sqrt(u * u + v * v) END"
DIRECTION = "(degrees(atan2(v, u)) + 360E0 - 360E0 * floor((degrees(atan2(v, u)) + 360E0) / 360E0))"


@query("wind_speed_dir", f"SELECT DISTINCT sid, round({WIND}, 6) AS speed, round({DIRECTION}, 6) AS direction FROM px", "px")
def wind_speed_dir(spark, d):
    return px(spark, d).select("sid", r6(X.wind_speed("u", "v")).alias("speed"), r6(X.wind_direction("u", "v")).alias("direction")).distinct()


@query("windspeed_mask", f"SELECT sid, count_if(u IS NULL OR {WIND} < 3E0) AS n_calm, count_if(u IS NULL OR {WIND} > 3E0) AS n_windy FROM px GROUP BY sid", "px")
def windspeed_mask(spark, d):
    s = X.wind_speed("u", "v")
    return px(spark, d).groupBy("sid").agg(F.count_if(M.calm(s, 3.0)).alias("n_calm"), F.count_if(M.calm(s, 3.0, invert=True)).alias("n_windy"))


@query("downwind_halfplane", f"SELECT sid, count_if(u IS NULL OR {DX} * cos(radians({DIRECTION})) + {DY} * sin(radians({DIRECTION})) <= 1E-6) AS n_half, count_if(u IS NULL) AS n_all FROM px GROUP BY sid", "px")
def downwind_halfplane(spark, d):
    half = M.dot_nonpositive("lon", "lat", "site_lon", "site_lat", X.wind_direction("u", "v"))
    return px(spark, d).groupBy("sid").agg(F.count_if(half).alias("n_half"), F.count_if(F.col("u").isNull()).alias("n_all"))


def masked_pixels(spark, d) -> DataFrame:
    p = px(spark, d).withColumns({"wind_speed": X.wind_speed("u", "v"), "wind_dir": X.wind_direction("u", "v"), "sgi": X.glint_index("b12", X.visible("b2", "b3", "b4"))})
    return tiered(p)


MASKED = f"masked AS (SELECT *, {WIND} AS wind_speed, {DIRECTION} AS wind_dir, {SGI} AS sgi FROM px JOIN tiers USING (sid))"
PARTS = {"saturation": "b11 < 10000 AND b12 < 10000", "cloud": CLOUD, "water": WATER, "wind": "(wind_speed IS NULL OR wind_speed < 9)", "sga": "sga < 30", "sgi": "sgi > -0.3E0"}
DATA = "b11 IS NOT NULL AND b12 IS NOT NULL"
IN5, IN15 = (f"({DX} * {DX} + {DY} * {DY} <= {r}E0)" for r in (25_000_000, 225_000_000))
OUT1 = f"({DX} * {DX} + {DY} * {DY} > 1000000E0)"
DOTS = f"({DX} * cos(radians(wind_dir)) + {DY} * sin(radians(wind_dir)))"
REGION = f"({IN5} AND ((u IS NULL OR NOT {DOTS} <= 1E-6) OR {OUT1}))"
C_MASK = f"coalesce({REGION} AND {DATA} AND " + " AND ".join(PARTS.values()) + ", false)"
M_MASK = f"coalesce({IN15} AND {DATA} AND " + " AND ".join(PARTS[k] for k in ("saturation", "cloud", "water", "wind")) + ", false)"


@query("mask_composite_mbsp", f"WITH tiers AS ({TIERS}), {MASKED} SELECT sid, count_if({M_MASK}) AS n_kept, count(*) AS n FROM masked GROUP BY sid", "px")
def mask_composite_mbsp(spark, d):
    return masked_pixels(spark, d).groupBy("sid").agg(F.count_if(M.composite(M.parts_for_mbsp())).alias("n_kept"), F.count("*").alias("n"))


@query("mask_composite_c", f"WITH tiers AS ({TIERS}), {MASKED} SELECT sid, count_if({C_MASK}) AS n_kept, count(*) AS n FROM masked GROUP BY sid", "px")
def mask_composite_c(spark, d):
    return masked_pixels(spark, d).groupBy("sid").agg(F.count_if(M.composite(M.parts_for_c())).alias("n_kept"), F.count("*").alias("n"))


_N = f"count_if({DATA})"


@query("mask_removal_pct", f"WITH tiers AS ({TIERS}), {MASKED} SELECT sid, {_N} AS total, " + ", ".join(
    f"round(CASE WHEN {_N} <> 0 THEN ({_N} - count_if({DATA} AND coalesce({f}, false))) * 100E0 / {_N} END, 6) AS {k}_pct" for k, f in PARTS.items()) + " FROM masked GROUP BY sid", "px")
def mask_removal_pct(spark, d):
    parts = {k: v for k, v in M.parts_for_c().items() if k not in ("region", "data_ok")}
    out = M.removal_pct(masked_pixels(spark, d), M.data_ok(), parts)
    return out.select("sid", "total", *[r6(f"{k}_pct").alias(f"{k}_pct") for k in parts])


@query("kept_fraction_gate", f"""
WITH tiers AS ({TIERS}), {MASKED}, k AS (SELECT sid, count_if({M_MASK}) AS m, count_if({DATA}) AS b FROM masked GROUP BY sid)
SELECT sid, count(*) AS n_pixels, round(any_value(m / CAST(b AS DOUBLE)), 6) AS kept FROM masked JOIN k USING (sid) WHERE b <> 0 AND m / CAST(b AS DOUBLE) >= 0.3E0 GROUP BY sid""", "px")
def kept_fraction_gate(spark, d):
    p = masked_pixels(spark, d).withColumn("m", M.composite(M.parts_for_mbsp())).withColumn("base", M.data_ok())
    kept = M.kept_fraction(p, "m", "base")
    return M.gated(p, kept, 0.3).groupBy("sid").agg(F.count("*").alias("n_pixels")).join(kept, "sid").select("sid", "n_pixels", r6("kept").alias("kept"))


@query("outlier_percentile", f"""
WITH lim AS (SELECT sid, quantile_cont(b11, 0.02E0) AS l11, quantile_cont(b11, 0.98E0) AS h11, quantile_cont(b12, 0.02E0) AS l12, quantile_cont(b12, 0.98E0) AS h12 FROM px WHERE {DATA} GROUP BY sid)
SELECT sid, count_if(coalesce({DATA} AND b11 BETWEEN l11 AND h11 AND b12 BETWEEN l12 AND h12, false)) AS n_inlier FROM px JOIN lim USING (sid) GROUP BY sid""", "px")
def outlier_percentile(spark, d):
    p = M.within_percentiles(px(spark, d), ["b11", "b12"], M.data_ok(), 0.02, 0.98)
    return p.groupBy("sid").agg(F.count_if("inlier").alias("n_inlier"))


@query("sea_mask", """
WITH lst AS (SELECT "row", col, CASE WHEN sid % 5 = 0 AND probability > 50 THEN probability END AS lst FROM px), m AS (SELECT "row", col, avg(lst) AS lst FROM lst GROUP BY 1, 2)
SELECT sid, count_if(coalesce(m.lst, 0) = 0) AS n_sea FROM px LEFT JOIN m ON m."row" = px."row" AND m.col = px.col GROUP BY sid""", "px")
def sea_mask(spark, d):
    p = px(spark, d)
    lst = p.select("row", "col", F.when((F.col("sid") % 5 == 0) & (F.col("probability") > 50), F.col("probability")).alias("lst"))
    return M.sea(p, lst, ["row", "col"]).groupBy("sid").agg(F.count_if("sea").alias("n_sea"))


@query("band_percentiles", "SELECT sid, round(quantile_cont(b11, 0.02E0), 6) AS p2, round(quantile_cont(b11, 0.98E0), 6) AS p98 FROM px GROUP BY sid", "px")
def band_percentiles(spark, d):
    p = px(spark, d).groupBy("sid").agg(F.percentile("b11", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    return p.select("sid", r6(F.col("p")[0]).alias("p2"), r6(F.col("p")[1]).alias("p98"))


@query("median_or_default", "SELECT sid, round(coalesce(median(CASE WHEN sid % 9 <> 0 THEN b11 END), 1500E0), 6) AS b11_median FROM px GROUP BY sid", "px")
def median_or_default(spark, d):
    return px(spark, d).groupBy("sid").agg(r6(F.coalesce(F.median(F.when(F.col("sid") % 9 != 0, F.col("b11"))), F.lit(1500.0))).alias("b11_median"))


@query("regr_intercept_sgi", f"SELECT sid, round(regr_intercept(b11, s), 3) AS a0, round(regr_slope(b11, s), 3) AS a1 FROM (SELECT *, {SGIC} AS s FROM px) GROUP BY sid", "px")
def regr_intercept_sgi(spark, d):
    a0, a1 = R.fit_with_intercept("b11", "s")
    p = px(spark, d).withColumn("s", X.glint_index_clamped("b12", X.visible("b2", "b3", "b4")))
    return p.groupBy("sid").agg(F.round(a0, 3).alias("a0"), F.round(a1, 3).alias("a1"))


TWO = "sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS t1, sum(x2 * y) AS t2"


@query("regr_two_pred_no_intercept", f"""
WITH n AS (SELECT sid, {TWO} FROM (SELECT sid, b12 AS x1, b12 * sga AS x2, b11 AS y FROM px WHERE b11 IS NOT NULL AND b12 IS NOT NULL) GROUP BY sid)
SELECT sid, round((t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12), 6) AS c0, round((s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12), 6) AS c1 FROM n""", "px")
def regr_two_pred_no_intercept(spark, d):
    c0, c1 = R.fit_two_without_intercept("b11", "b12", F.col("b12") * F.col("sga"))
    return px(spark, d).groupBy("sid").agg(r6(c0).alias("c0"), r6(c1).alias("c1"))


COMPLEX = f"""
WITH refl AS (SELECT * REPLACE (b2 / 1E4 AS b2, b3 / 1E4 AS b3, b4 / 1E4 AS b4, b11 / 1E4 AS b11, b12 / 1E4 AS b12) FROM px),
p AS (SELECT *, {SGIC} AS s, {DX} * {DX} + {DY} * {DY} <= REACH AS near FROM refl), f1 AS (SELECT sid, regr_intercept(b11, s) AS a0, regr_slope(b11, s) AS a1 FROM p WHERE near GROUP BY sid),
q AS (SELECT p.*, b11 - (a0 + a1 * s) AS b11f, b12 - (a0 + a1 * s) * b12 / (b11 + 1E-6) AS b12f FROM p JOIN f1 USING (sid)),
n AS (SELECT sid, {TWO} FROM (SELECT sid, b12f AS x1, b12f * s AS x2, b11f AS y FROM q WHERE near AND b11f IS NOT NULL AND b12f IS NOT NULL) GROUP BY sid),
c AS (SELECT sid, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) AS c0, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS c1 FROM n)
SELECT sid, round(any_value(c0), 4) AS c0, round(any_value(c1), 4) AS c1, count(r) AS n_r, round(median(r), 4) AS r_median
FROM (SELECT *, CASE WHEN sga > 5 AND sga < 35 THEN ((c0 + c1 * s) * b12f - b11f) / (b11f + 1E-6) END AS r FROM q JOIN c USING (sid)) GROUP BY sid"""


def two_fits(p: DataFrame) -> DataFrame:
    return p.groupBy("sid").agg(F.round(F.max("c0"), 4).alias("c0"), F.round(F.max("c1"), 4).alias("c1"), F.count("r").alias("n_r"), F.round(F.median("r"), 4).alias("r_median"))


@query("mbsp_complex", COMPLEX.replace("REACH", "2500000000E0"), "px")
def mbsp_complex(spark, d):
    return two_fits(R.complex_retrieval(px(spark, d), 5.0, 35.0))


@query("mbsp_complex_near", COMPLEX.replace("REACH", "40000E0"), "px")
def mbsp_complex_near(spark, d):
    """Both fits within 200 m of the site, where the scenes reach further."""
    return two_fits(R.complex_retrieval(px(spark, d), 5.0, 35.0, reach_m=200.0))


@query("corrected_band", """
SELECT sid, round(sum(b12 * coalesce(c, 1E0)), 0) AS total FROM px LEFT JOIN (SELECT sid, sum(b11 * b12) / sum(CASE WHEN b11 IS NOT NULL THEN b12 * b12 END) AS c FROM px WHERE sid % 4 <> 0 GROUP BY sid) f USING (sid) GROUP BY sid""", "px")
def corrected_band(spark, d):
    p = px(spark, d)
    fit = R.scene_factors(p.where(F.col("sid") % 4 != 0))
    return p.join(fit, "sid", "left").groupBy("sid").agg(F.round(F.sum(X.corrected("b12", "c")), 0).alias("total"))


@query("two_date_difference", """
WITH r AS MATERIALIZED (SELECT sid, "row", col, CASE WHEN b11 <> 0 THEN (c * b12 - b11) / b11 END AS r FROM (
  SELECT *, sum(b11 * b12) OVER (PARTITION BY sid) / sum(CASE WHEN b11 IS NOT NULL THEN b12 * b12 END) OVER (PARTITION BY sid) AS c FROM px))
SELECT a.sid, a."row" AS grid_row, a.col AS grid_col, round(a.r - b.r, 6) AS mbmp FROM r a JOIN r b ON b.sid = a.sid + 1 AND a."row" = b."row" AND a.col = b.col WHERE a.sid % 2 = 0""", "px")
def two_date_difference(spark, d):
    r = R.fractional_absorption(px(spark, d)).select("sid", "row", "col", "r")
    target = r.where("sid % 2 = 0").withColumn("pair", F.col("sid"))
    reference = r.where("sid % 2 = 1").select((F.col("sid") - 1).alias("pair"), "row", "col", "r")
    return R.two_date_difference(target, reference, ["pair", "row", "col"]).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), r6("mbmp").alias("mbmp"))


@query("zonal_scene_eval", f"""
WITH z AS (SELECT sid, avg(probability) AS cl, min(CASE WHEN b3 + b8 <> 0 THEN (b3 - b8) / (b3 + b8) END) AS nd, max({TAI}) AS ta FROM px GROUP BY sid),
y AS (SELECT sid, coalesce(cl, 100E0) AS cl, coalesce(nd, 9999E0) AS nd, coalesce(ta, -9999E0) AS ta FROM z)
SELECT sid, round(cl, 6) AS cloud_fraction, round(nd, 6) AS min_ndwi, round(ta, 6) AS max_tai, CAST(nd < 0 AS INT) AS structure_present, CAST(ta > 0.15E0 AS INT) AS flare_present FROM y""", "px")
def zonal_scene_eval(spark, d):
    return zonal(px(spark, d), ["sid"]).select("sid", r6("cloud_fraction").alias("cloud_fraction"), r6("min_ndwi").alias("min_ndwi"), r6("max_tai").alias("max_tai"), "structure_present", "flare_present")


@query("speckle_logistic", """
WITH x AS (SELECT sid, "row", col, CASE WHEN b11 <> 0 THEN (b12 - b11) / b11 END AS r FROM px)
SELECT a.sid, a."row" AS grid_row, a.col AS grid_col, round(any_value(a.r) * (1 / (1 + exp(20E0 * (sqrt(var_pop(b.r)) - 0.1E0)))), 5) AS filtered
FROM x a JOIN x b ON a.sid = b.sid AND b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.sid, a."row", a.col""", "px")
def speckle_logistic(spark, d):
    p = px(spark, d).select("sid", "row", "col", X.divided(F.col("b12") - F.col("b11"), "b11").alias("r"))
    p = N.logistic_speckle(N.complete(p), "r", 1, 0.1, 20.0).where("present")
    return p.select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), F.round("filtered", 5).alias("filtered"))


MEDIAN = """SELECT a.sid, a."row" AS grid_row, a.col AS grid_col, round(median(b.b11), 6) AS focal_median
FROM px a LEFT JOIN px b ON a.sid = b.sid AND b."row" BETWEEN a."row" - {r} AND a."row" + {r} AND b.col BETWEEN a.col - {r} AND a.col + {r} GROUP BY a.sid, a."row", a.col"""


@query("focal_median", MEDIAN.format(r=1), "px")
def focal_median(spark, d):
    return N.focal_median_small(px(spark, d), "b11", 1).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), r6("focal_median").alias("focal_median"))


@query("focal_median_tiled", MEDIAN.format(r=3), "px")
def focal_median_tiled(spark, d):
    return N.focal_median_tiled(px(spark, d), "b11", 3, tile=16).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), r6("focal_median").alias("focal_median"))


@query("bilinear_upsample", """
WITH coarse AS (SELECT sid, CAST("row" / 4 AS INT) AS i, CAST(col / 4 AS INT) AS j, b3 AS v FROM px WHERE "row" % 4 = 0 AND col % 4 = 0),
w AS (SELECT f.sid, f."row", f.col, c.v, (CASE WHEN a = 1 THEN f."row" / 4E0 - floor(f."row" / 4E0) ELSE 1 - (f."row" / 4E0 - floor(f."row" / 4E0)) END) * (CASE WHEN b = 1 THEN f.col / 4E0 - floor(f.col / 4E0) ELSE 1 - (f.col / 4E0 - floor(f.col / 4E0)) END) AS w
  FROM px f CROSS JOIN (VALUES (0), (1)) s(a) CROSS JOIN (VALUES (0), (1)) t(b) LEFT JOIN coarse c ON c.sid = f.sid AND c.i = floor(f."row" / 4E0) + a AND c.j = floor(f.col / 4E0) + b)
SELECT sid, "row" AS grid_row, col AS grid_col, round(sum(v * w) / nullif(sum(CASE WHEN v IS NOT NULL THEN w END), 0), 6) AS b3 FROM w WHERE w > 0 GROUP BY 1, 2, 3""", "px")
def bilinear_upsample(spark, d):
    p = px(spark, d)
    coarse = p.where("row % 4 = 0 and col % 4 = 0").select("sid", (F.col("row") / 4).cast("int").alias("i"), (F.col("col") / 4).cast("int").alias("j"), "b3")
    return N.bilinear(coarse, p.select("sid", "row", "col"), "b3", 4.0).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), r6("b3").alias("b3"))


@query("dense_fill", "SELECT sid, round(sum(coalesce(b11, 0E0)), 0) AS total, count(coalesce(b11, 0E0)) AS n FROM px GROUP BY sid", "px")
def dense_fill(spark, d):
    return N.dense(px(spark, d), "b11").groupBy("sid").agg(F.round(F.sum("b11"), 0).alias("total"), F.count("b11").alias("n"))


@query("detector_mean", """
SELECT sid, i, j, round(avg(v), 6) AS value FROM (SELECT sid, "row" % 5 AS i, col % 5 AS j, cs_cdf AS v FROM px) GROUP BY 1, 2, 3""", "px")
def detector_mean(spark, d):
    g = px(spark, d).select("sid", F.lit("view").alias("kind"), (F.col("row") % 5).alias("i"), (F.col("col") % 5).alias("j"), F.coalesce("cs_cdf", F.lit(float("nan"))).alias("value"))
    return N.detector_mean(g).select("sid", "i", "j", r6("value").alias("value"))


T = PlumeThresholds()
RATIO = """ratio AS (SELECT sid, CAST("row" AS BIGINT) AS r, CAST(col AS BIGINT) AS c, CASE WHEN b11 <> 0 THEN (k * b12 - b11) / b11 END AS x FROM (
  SELECT *, sum(b11 * b12) OVER (PARTITION BY sid) / sum(CASE WHEN b11 IS NOT NULL THEN b12 * b12 END) OVER (PARTITION BY sid) AS k FROM px))"""
HYSTERESIS = """p1 AS (SELECT *, r * 1000000 + c AS own FROM ratio WHERE x <= -0.02E0),
reach(sid, own, label) AS (SELECT sid, own, own FROM p1 UNION SELECT n.sid, n.own, reach.label FROM reach JOIN p1 m ON m.sid = reach.sid AND m.own = reach.own
  JOIN p1 n ON n.sid = m.sid AND abs(n.r - m.r) + abs(n.c - m.c) = 1 AND reach.label < n.own),
lab AS (SELECT sid, own, min(label) AS label FROM reach GROUP BY 1, 2), cells AS (SELECT p1.sid, p1.r, p1.c, label, x FROM p1 JOIN lab USING (sid, own)),
strong AS (SELECT DISTINCT sid, label FROM cells WHERE x <= -0.08E0), plume AS (SELECT cells.* FROM cells JOIN strong USING (sid, label) WHERE x <= -0.04E0)"""
PLUMES = f"{RATIO}, {HYSTERESIS}"


def ratios(spark, d) -> DataFrame:
    return R.fractional_absorption(px(spark, d)).select("sid", "row", "col", "r")


@query("plume_components", f"""WITH RECURSIVE {PLUMES}
SELECT sid, label, count(*) AS n_px, round(avg(x), 6) AS mean_conf, round(median(x), 6) AS median_conf, round(max(x), 6) AS max_conf, round(median(x), 6) AS machine_confidence, round(min(x), 6) AS extreme_conf
FROM plume GROUP BY sid, label""", "px")
def plume_components(spark, d):
    s = G.plume_stats(G.plume_pixels(ratios(spark, d), "r", T.p1, T.p2, T.p3))
    return s.select("sid", "label", "n_px", *[r6(c).alias(c) for c in ("mean_conf", "median_conf", "max_conf", "machine_confidence", "extreme_conf")])


@query("plume_outlines")
def plume_outlines(spark, d):
    return G.plume_outlines(G.plume_pixels(ratios(spark, d), "r", T.p1, T.p2, T.p3))


@query("plume_outline_masks", f"""WITH RECURSIVE {PLUMES}
SELECT sid, label, count(*) AS n_px, CAST(sum(r) AS BIGINT) AS rows_sum, CAST(sum(c) AS BIGINT) AS cols_sum FROM plume GROUP BY sid, label""", "px")
def plume_outline_masks(spark, d):
    """The outlines burnt back into the grid: the cells they were drawn around."""
    cells = G.burnt(plume_outlines(spark, d))
    return cells.groupBy("sid", "label").agg(F.count("*").alias("n_px"), F.sum("row").alias("rows_sum"), F.sum("col").alias("cols_sum"))


@query("flare_centroids", f"""WITH RECURSIVE t AS (SELECT *, {TAI} AS tai FROM px), hot AS (
  SELECT sid, CAST("row" AS BIGINT) AS r, CAST(col AS BIGINT) AS c, lon, lat, "row" * 1000000 + col AS own FROM (SELECT *, max(tai) OVER (PARTITION BY sid) AS top FROM t) WHERE tai = top),
reach(sid, own, label) AS (SELECT sid, own, own FROM hot UNION SELECT n.sid, n.own, reach.label FROM reach JOIN hot m ON m.sid = reach.sid AND m.own = reach.own
  JOIN hot n ON n.sid = m.sid AND abs(n.r - m.r) + abs(n.c - m.c) = 1 AND reach.label < n.own),
lab AS (SELECT sid, own, min(label) AS label FROM reach GROUP BY 1, 2)
SELECT sid, CAST(row_number() OVER (PARTITION BY sid ORDER BY label) - 1 AS INT) AS place, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM hot JOIN lab USING (sid, own) GROUP BY sid, label""", "px")
def flare_centroids(spark, d):
    p = px(spark, d).select("sid", "row", "col", "lon", "lat", X.thermal_anomaly("b8a", "b11", "b12").alias("tai"))
    found = G.flare_centroids(p).select("sid", F.posexplode("centroids").alias("place", "centre"))
    return found.select("sid", "place", r6(F.col("centre.lon")).alias("lon"), r6(F.col("centre.lat")).alias("lat"))


@query("pixel_composite", """
SELECT "row" AS grid_row, col AS grid_col, min(sga) AS sga_min, max(sga) AS sga_max, round(avg(sga), 6) AS sga_mean, count(sga) AS n FROM (
  SELECT "row", col, CASE WHEN b12 IS NOT NULL THEN sga END AS sga FROM px) GROUP BY 1, 2""", "px")
def pixel_composite(spark, d):
    p = px(spark, d).withColumn("seen", F.when(F.col("b12").isNotNull(), F.col("sga")))
    out = T_.pixel_composite(p, "seen", ["row", "col"])
    return out.select(F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), F.col("seen_min").alias("sga_min"), F.col("seen_max").alias("sga_max"), r6("seen_mean").alias("sga_mean"), "n")


@query("absorption_roundtrip", "SELECT sid, \"row\" AS grid_row, col AS grid_col, round(exp(-2E0 * sga / 80E0) - exp(-1E0 * sga / 80E0), 6) AS ratio, round(sga / 80E0, 6) AS amount FROM px", "px")
def absorption_roundtrip(spark, d):
    a = X.absorption(F.col("sga") / 80.0, 1.0, 2.0)
    return px(spark, d).select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), r6(a).alias("ratio"), r6(X.inverted_absorption(a, 1.0, 2.0)).alias("amount"))
