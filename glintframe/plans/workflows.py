"""The workflows end to end, one plan for all scenes: plumes, flaring, glint products.

Scenes that fail a gate are rows of a status table, not exceptions; nothing loops over scenes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MaskParams, PlumeThresholds, Speckle
from ..functions import scalars as X
from ..operators import masks as M
from ..operators import neighbour as N
from ..operators import plumes as G
from ..operators import retrieval as R
from ..operators import timeline as T
from ..sources import readers
from .adapters import view
from .catalog import ALPHA, DX, DY, query, r6
from .pixel_queries import C_MASK, DATA, HYSTERESIS, IN15, M_MASK, MASKED, OUT1, REGION, TIERS


@dataclass(frozen=True)
class PlumeResult:
    status: DataFrame  # sid, kept_c, kept_mbsp, status
    ratio: DataFrame  # sid, row, col, r
    plumes: DataFrame  # sid, label and statistics
    pixels: DataFrame  # sid, row, col, label, value of plume pixels


def with_derived_bands(pixels: DataFrame) -> DataFrame:
    """b_vis, sgi, wind_speed, wind_dir, has_cs, has_probability beside the bands."""
    p = pixels.withColumn("b_vis", X.visible("b2", "b3", "b4"))
    p = p.withColumns({"sgi": X.glint_index("b12", "b_vis"), "wind_speed": X.wind_speed("u", "v"), "wind_dir": X.wind_direction("u", "v")})
    return p.join(M.scene_cloud_tiers(p), "sid")


def plume_workflow(pixels: DataFrame, params: MaskParams | None = None, thresholds: PlumeThresholds | None = None, speckle_mode: str = "none", speckle: Speckle | None = None, simple: bool = True) -> PlumeResult:
    """Masks, gates, retrieval, speckle filter and plumes of all scenes.

    pixels: sid, row, col, lon, lat, site_lon, site_lat, bands, sga, u, v, cs_cdf, probability. The
    kept fractions count in the box of the local radius around the site for both masks.
    """
    p, t, s = params or MaskParams(), thresholds or PlumeThresholds(), speckle or Speckle()
    px = with_derived_bands(pixels)
    px = px.withColumn("mask_c", M.composite(M.parts_for_c(p))).withColumn("mask_mbsp", M.composite(M.parts_for_mbsp(p)))
    c_base = {k: v for k, v in M.parts_for_c(p).items() if k in ("region", "data_ok")}
    m_base = {k: v for k, v in M.parts_for_mbsp(p).items() if k in ("region", "data_ok")}
    dx, dy = X.metre_offsets("lon", "lat", "site_lon", "site_lat")
    box = (F.abs(dx) <= p.radii.local_m) & (F.abs(dy) <= p.radii.local_m)
    on = lambda mask: F.count_if(box & mask)
    kept = px.groupBy("sid").agg(X.divided(on(F.col("mask_c")), on(M.composite(c_base))).alias("kept_c"), X.divided(on(F.col("mask_mbsp")), on(M.composite(m_base))).alias("kept_mbsp"))
    status = kept.withColumn("status", F.when(F.coalesce(F.col("kept_c") < p.least_kept, F.lit(True)), "c mask mostly empty").when(F.coalesce(F.col("kept_mbsp") < p.least_kept, F.lit(True)), "mbsp mask mostly empty").otherwise("ok"))
    px = px.join(status.where("status = 'ok'").select("sid"), "sid", "left_semi")
    if simple:
        px = R.retrieval(px, F.col("mask_c"), F.col("mask_mbsp"))
    else:
        px = R.complex_retrieval(px, p.glint.scene_low, p.glint.local_high)
    exported = M.radius("lon", "lat", "site_lon", "site_lat", p.radii.export_m)
    px = px.withColumn("r", F.when(exported, F.col("r").cast("float")))
    if speckle_mode == "adaptive":
        px = N.logistic_speckle(N.complete(px), "r", s.radius_px, s.sigma0, s.k).where("present").withColumn("r", F.col("filtered"))
    elif speckle_mode == "median":
        px = px.drop("r").join(N.focal_median_tiled(px, "r", s.radius_px).withColumnRenamed("focal_median", "r"), ["sid", "row", "col"])
    near = px.where(M.radius("lon", "lat", "site_lon", "site_lat", p.radii.plume_m))
    cells = G.plume_pixels(N.dense(near, "r"), "r", t.p1, t.p2, t.p3)
    return PlumeResult(status, px.select("sid", "row", "col", "r"), G.plume_stats(cells), cells)


@query("plume_workflow", f"""WITH RECURSIVE tiers AS ({TIERS}), {MASKED},
m AS (SELECT *, {C_MASK} AS mc, {M_MASK} AS mm, coalesce({REGION} AND {DATA}, false) AS bc, coalesce({IN15} AND {DATA}, false) AS bm, abs({DX}) <= 5000 AND abs({DY}) <= 5000 AS box FROM masked),
k AS (SELECT sid, count_if(box AND mc) / nullif(count_if(box AND bc), 0) AS kept_c, count_if(box AND mm) / nullif(count_if(box AND bm), 0) AS kept_mbsp FROM m GROUP BY sid),
st AS (SELECT *, CASE WHEN coalesce(kept_c < 0.05E0, true) THEN 'c mask mostly empty' WHEN coalesce(kept_mbsp < 0.05E0, true) THEN 'mbsp mask mostly empty' ELSE 'ok' END AS status FROM k),
ratio AS (SELECT sid, CAST("row" AS BIGINT) AS r, CAST(col AS BIGINT) AS c, CASE WHEN mm AND b11 <> 0 THEN CAST(CAST((slope * b12 - b11) / b11 AS FLOAT) AS DOUBLE) END AS x FROM (
  SELECT m.*, sum(CASE WHEN mc THEN b11 * b12 END) OVER (PARTITION BY sid) / sum(CASE WHEN mc THEN b12 * b12 END) OVER (PARTITION BY sid) AS slope FROM m JOIN st USING (sid) WHERE status = 'ok') WHERE NOT {OUT1}),
{HYSTERESIS}
SELECT sid, status, round(kept_c, 6) AS kept_c, round(kept_mbsp, 6) AS kept_mbsp, coalesce(n_plumes, 0) AS n_plumes, strongest
FROM st LEFT JOIN (SELECT sid, count(DISTINCT label) AS n_plumes, round(min(x), 6) AS strongest FROM plume GROUP BY sid) USING (sid)""", "px")
def plume_workflow_query(spark: SparkSession, d: str) -> DataFrame:
    """Status and number of plumes of every scene."""
    out = plume_workflow(view(spark, d, "px"), MaskParams(least_kept=0.05))
    found = out.plumes.groupBy("sid").agg(F.count("*").alias("n_plumes"), r6(F.min("extreme_conf")).alias("strongest"))
    return out.status.join(found, "sid", "left").select("sid", "status", r6("kept_c").alias("kept_c"), r6("kept_mbsp").alias("kept_mbsp"), F.coalesce("n_plumes", F.lit(0)).alias("n_plumes"), "strongest")


@dataclass(frozen=True)
class FlaringResult:
    summary: DataFrame
    timeline: DataFrame
    blocks: DataFrame


def flaring_workflow(obs: DataFrame, cloud_below: float = 15.0, strong: float = 0.5, flare_first: bool = True) -> FlaringResult:
    """Clear observations -> summary, distance to the strong flares' centre, flaring rule, timeline, blocks.

    obs: structure_id, system_index, granule_date, lon, lat, cloud_fraction, structure_present,
    flare_present, max_tai.
    """
    clear = obs.where(F.col("cloud_fraction") < cloud_below)
    x, y = X.to_mercator("lon", "lat")
    clear = clear.withColumn("x", x).withColumn("y", y)
    centre = clear.where(F.col("max_tai") >= strong).groupBy("structure_id").agg(F.avg("x").alias("x_flare_centroid"), F.avg("y").alias("y_flare_centroid"))
    met = clear.join(centre, "structure_id", "left").withColumn("dist", X.planar_distance("x", "y", "x_flare_centroid", "y_flare_centroid"))
    met = met.withColumn("flare_present", F.coalesce(X.derived_flaring("max_tai", "dist"), F.lit(False)).cast("int"))
    line = T.timeline(met, flare_first)
    return FlaringResult(T.structure_summary(clear), line, T.state_blocks(line))


@query("flaring_workflow", """
WITH o AS (SELECT *, radians(lon) * 6378137E0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137E0 AS y FROM obs WHERE cloud_fraction < 60),
c AS (SELECT structure_id, avg(x) AS cx, avg(y) AS cy FROM o WHERE max_tai >= 0.4E0 GROUP BY 1),
e AS (SELECT o.structure_id, system_index, granule_date, structure_present, CASE WHEN (max_tai > 0.01E0 AND sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) < 40) OR max_tai > 0.5E0 THEN 1 ELSE 0 END AS f FROM o LEFT JOIN c USING (structure_id)),
t AS (SELECT *, CASE WHEN f = 1 THEN 'green' WHEN structure_present = 0 THEN 'red' ELSE 'yellow' END AS colour FROM e),
g AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id ORDER BY granule_date, system_index ROWS UNBOUNDED PRECEDING) AS block FROM (SELECT *, colour IS DISTINCT FROM lag(colour) OVER (PARTITION BY structure_id ORDER BY granule_date, system_index) AS changed FROM t))
SELECT structure_id, min(granule_date) AS start_ts, max(granule_date) AS end_ts, CASE colour WHEN 'green' THEN 'flaring on' WHEN 'yellow' THEN 'flaring off' ELSE 'structure absent' END AS state, count(*) AS granules
FROM g GROUP BY structure_id, block, colour HAVING max(granule_date) > min(granule_date)""", "obs")
def flaring_workflow_query(spark: SparkSession, d: str) -> DataFrame:
    out = flaring_workflow(view(spark, d, "obs"), 60.0, 0.4)
    return out.blocks.select("structure_id", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "state", "granules")


def glint_grid(angles: DataFrame) -> DataFrame:
    """sid, i, j, sza, saa, vza, vaa, sga of granule angle grids (sid, kind, i, j, value), detectors averaged."""
    mean = N.detector_mean(angles)
    wide = mean.groupBy("sid", "i", "j").pivot("kind", ["sun_zenith", "sun_azimuth", "view_zenith", "view_azimuth"]).agg(F.first("value")).toDF("sid", "i", "j", "sza", "saa", "vza", "vaa")
    return wide.withColumn("sga", X.glint_angle("sza", "vza", "saa", "vaa"))


def glint_composite(scenes: DataFrame, cloud_below: float = 20.0) -> DataFrame:
    """Least and largest angle of each month and tile over usable scenes, with the products' names."""
    from ..sources.sinks import composite_name

    s = scenes.where(M.scene_cloud_ok(most=cloud_below) & M.angles_known() & M.angles_positive())
    s = s.withColumn("alpha", X.glint_alpha("sza", "saa", "vza_b11", "vza_b12", "vaa_b11", "vaa_b12")).withColumn("month_start", F.date_trunc("month", "sensing_ts").cast("timestamp_ntz"))
    out = s.groupBy("month_start", "tile").agg(F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"))
    return out.withColumn("min_name", composite_name("month_start", "min")).withColumn("max_name", composite_name("month_start", "max"))


@query("glint_composite", f"""
SELECT month_start, tile, round(min(alpha), 6) AS alpha_min, round(max(alpha), 6) AS alpha_max, any_value(name || 'min') AS min_name, any_value(name || 'max') AS max_name
FROM (SELECT tile, date_trunc('month', sensing_ts) AS month_start, {ALPHA} AS alpha, lower(strftime(sensing_ts, '%B')) || strftime(sensing_ts, '%Y') || '_sunglintAlpha_' AS name
      FROM scene WHERE cloudy_pixel_pct < 20 AND sza > 0 AND saa > 0 AND vza_b11 > 0 AND vaa_b11 > 0 AND vza_b12 > 0 AND vaa_b12 > 0) GROUP BY month_start, tile""", "scene")
def glint_composite_query(spark: SparkSession, d: str) -> DataFrame:
    out = glint_composite(view(spark, d, "scene"))
    return out.select("month_start", "tile", r6("alpha_min").alias("alpha_min"), r6("alpha_max").alias("alpha_max"), "min_name", "max_name")


def granule_glint(spark: SparkSession, paths: str) -> DataFrame:
    """The coarse glint grid of granule XML files."""
    return glint_grid(readers.granule_angles(spark, paths))
