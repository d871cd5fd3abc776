"""Queries on observations and sites: timelines, summaries, joins, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import masks as M
from ..operators import spatial as S
from ..operators import timeline as T
from ..sources import readers, sinks
from .adapters import table, view
from .catalog import COLOUR, DX, DY, query, r6


def obs(spark, d) -> DataFrame:
    return view(spark, d, "obs")


TL = f"""c AS (SELECT *, {COLOUR} AS colour FROM obs), t AS (SELECT *,
  colour IS DISTINCT FROM lag(colour) OVER w AND colour IS DISTINCT FROM lead(colour) OVER w AS is_outlier FROM c WINDOW w AS (PARTITION BY structure_id ORDER BY granule_date, system_index))"""


def blocks_sql(source: str, where: str) -> str:
    return f"""g AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY structure_id ORDER BY granule_date, system_index ROWS UNBOUNDED PRECEDING) AS block FROM (
  SELECT *, colour IS DISTINCT FROM lag(colour) OVER (PARTITION BY structure_id ORDER BY granule_date, system_index) AS changed FROM {source})),
b AS (SELECT structure_id, block, colour, min(granule_date) AS start_ts, max(granule_date) AS end_ts, count(*) AS granules FROM g GROUP BY 1, 2, 3)
SELECT structure_id, start_ts, end_ts, CASE colour WHEN 'green' THEN 'flaring on' WHEN 'yellow' THEN 'flaring off' ELSE 'structure absent' END AS state, CAST(floor((epoch_us(end_ts) - epoch_us(start_ts)) / 1E6) AS BIGINT) AS duration_s, granules FROM b {where}"""


@query("timeline_colour_outlier", f"WITH {TL} SELECT structure_id, system_index, colour, is_outlier FROM t", "obs")
def timeline_colour_outlier(spark, d):
    return T.timeline(obs(spark, d)).select("structure_id", "system_index", "colour", "is_outlier")


@query("timeline_absent_first", "SELECT structure_id, system_index, CASE WHEN structure_present = 0 THEN 'red' WHEN flare_present = 1 THEN 'green' ELSE 'yellow' END AS colour FROM obs", "obs")
def timeline_absent_first(spark, d):
    return T.timeline(obs(spark, d), flare_first=False).select("structure_id", "system_index", "colour")


def blocks(df: DataFrame) -> DataFrame:
    return df.select("structure_id", F.col("start").alias("start_ts"), F.col("end").alias("end_ts"), "state", "duration_s", "granules")


@query("state_blocks", f"WITH {TL}, {blocks_sql('t', '')}", "obs")
def state_blocks(spark, d):
    return blocks(T.state_blocks(T.timeline(obs(spark, d)), drop_zero=False))


@query("state_blocks_without_outliers", f"WITH {TL}, k AS (SELECT * FROM t WHERE NOT is_outlier), {blocks_sql('k', 'WHERE end_ts > start_ts')}", "obs")
def state_blocks_without_outliers(spark, d):
    return blocks(T.state_blocks(T.timeline(obs(spark, d), drop_outliers=True)))


@query("structure_summary_having", """
WITH s AS (SELECT structure_id, count(*) AS n_total, count_if(structure_present = 1) AS n_present, count_if(flare_present = 1) AS n_flare,
  min(CASE WHEN structure_present = 1 THEN granule_date END) AS first_present, max(CASE WHEN structure_present = 1 THEN granule_date END) AS last_present FROM obs GROUP BY 1)
SELECT structure_id, n_total, n_present, n_flare, first_present, last_present, round(n_present * 100E0 / n_total, 6) AS present_percent, round(n_flare * 100E0 / nullif(n_present, 0), 6) AS flare_percent
FROM s WHERE n_present * 100E0 / n_total > 75 AND n_flare * 100E0 / nullif(n_present, 0) > 50""", "obs")
def structure_summary_having(spark, d):
    s = T.structure_summary(obs(spark, d), 75.0, 50.0)
    return s.select("structure_id", "n_total", "n_present", "n_flare", "first_present", "last_present", r6("present_percent").alias("present_percent"), r6("flare_percent").alias("flare_percent"))


@query("top5_flare_percent", """
WITH s AS (SELECT structure_id, round(count_if(flare_present = 1) * 100E0 / nullif(count_if(structure_present = 1), 0), 6) AS flare_percent FROM obs GROUP BY 1)
SELECT structure_id, flare_percent FROM s ORDER BY flare_percent DESC NULLS LAST, structure_id LIMIT 5""", "obs")
def top5_flare_percent(spark, d):
    s = T.structure_summary(obs(spark, d), -1.0, -1.0).select("structure_id", r6("flare_percent").alias("flare_percent"))
    return s.orderBy(F.desc_nulls_last("flare_percent"), "structure_id").limit(5)


@query("strong_tai_stats", "SELECT structure_id, round(avg(max_tai) + 1E-9, 6) AS tai_mean, round(stddev_samp(max_tai), 6) AS tai_std, count(*) AS tai_n FROM obs WHERE max_tai >= 0.3E0 GROUP BY 1", "obs")
def strong_tai_stats(spark, d):
    return T.strong_stats(obs(spark, d), 0.3).select("structure_id", r6(F.col("tai_mean") + 1e-9).alias("tai_mean"), r6("tai_std").alias("tai_std"), "tai_n")


@query("clear_observations", "SELECT structure_id, system_index FROM obs WHERE cloud_fraction < 15", "obs")
def clear_observations(spark, d):
    return obs(spark, d).where("cloud_fraction < 15").select("structure_id", "system_index")


@query("aligned_counts", """
SELECT coalesce(a.k, b.k, c.k) AS structure_id, coalesce(a.n, 0) AS n_clear, coalesce(b.n, 0) AS n_strong, coalesce(c.n, 0) AS n_flare FROM
(SELECT structure_id AS k, count(*) AS n FROM obs WHERE cloud_fraction < 3 GROUP BY 1) a FULL JOIN (SELECT structure_id AS k, count(*) AS n FROM obs WHERE max_tai >= 0.5E0 GROUP BY 1) b ON a.k = b.k
FULL JOIN (SELECT structure_id AS k, count(*) AS n FROM obs WHERE flare_present = 1 GROUP BY 1) c ON c.k = coalesce(a.k, b.k)""", "obs")
def aligned_counts(spark, d):
    """Counts that would be aligned by outer joins, in one pass."""
    o = obs(spark, d).groupBy("structure_id").agg(F.count_if(F.col("cloud_fraction") < 3).alias("n_clear"), F.count_if(F.col("max_tai") >= 0.5).alias("n_strong"), F.count_if(F.col("flare_present") == 1).alias("n_flare"))
    return o.where("n_clear + n_strong + n_flare > 0")


@query("flare_centroid_distance", """
WITH o AS (SELECT *, radians(lon) * 6378137E0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137E0 AS y FROM obs),
c AS (SELECT structure_id, avg(x) AS cx, avg(y) AS cy FROM o WHERE max_tai >= 0.2E0 GROUP BY 1)
SELECT system_index, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), 3) AS dist FROM o LEFT JOIN c USING (structure_id)""", "obs")
def flare_centroid_distance(spark, d):
    o = with_distance(spark, d)
    return o.select("system_index", F.round("dist", 3).alias("dist"))


def with_distance(spark, d) -> DataFrame:
    x, y = X.to_mercator("lon", "lat")
    o = obs(spark, d).withColumn("x", x).withColumn("y", y)
    centre = o.where("max_tai >= 0.2").groupBy("structure_id").agg(F.avg("x").alias("x_flare_centroid"), F.avg("y").alias("y_flare_centroid"))
    return o.join(centre, "structure_id", "left").withColumn("dist", X.planar_distance("x", "y", "x_flare_centroid", "y_flare_centroid"))


@query("derived_flaring", """
WITH o AS (SELECT *, radians(lon) * 6378137E0 AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137E0 AS y FROM obs),
c AS (SELECT structure_id, avg(x) AS cx, avg(y) AS cy FROM o WHERE max_tai >= 0.2E0 GROUP BY 1),
e AS (SELECT structure_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist, max_tai FROM o LEFT JOIN c USING (structure_id))
SELECT structure_id, count_if((max_tai > 0.01E0 AND dist < 40) OR max_tai > 0.5E0) AS n_flaring FROM e GROUP BY 1""", "obs")
def derived_flaring(spark, d):
    return with_distance(spark, d).groupBy("structure_id").agg(F.count_if(X.derived_flaring("max_tai", "dist")).alias("n_flaring"))


@query("clipped_magnitude", "SELECT system_index, round(CASE WHEN abs(max_tai) > 0.3E0 THEN 0.3E0 ELSE max_tai END, 6) AS magnitude FROM obs", "obs")
def clipped_magnitude(spark, d):
    return obs(spark, d).select("system_index", r6(X.clipped_magnitude("max_tai", 0.3)).alias("magnitude"))


@query("next_and_previous", "WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS k FROM customer) SELECT c_custkey, (i + 1) % k AS following, (i - 1 + k) % k AS preceding FROM n")
def next_and_previous(spark, d):
    c = table(spark, d, "customer")
    lowest = c.agg(F.min("c_custkey").alias("lo"))  # keys have no gaps, so their place needs no global sort
    i = c.join(F.broadcast(lowest)).select("c_custkey", (F.col("c_custkey") - F.col("lo")).alias("i"))
    ahead = T.wrapped(i, "i", 1).withColumnRenamed("target", "following")
    return T.wrapped(ahead, "i", -1).select("c_custkey", "following", F.col("target").alias("preceding"))


WIND = """i AS (SELECT event_id AS image_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT ts, value AS u, CAST(event_id % 17 AS DOUBLE) AS v FROM events WHERE event_type = 'view'),
m AS (SELECT image_id, r.ts AS record_ts, u, v, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY image_id) AS n FROM i JOIN r ON r.ts >= i.ts - INTERVAL 1 HOUR AND r.ts < i.ts + INTERVAL 1 HOUR)
SELECT i.image_id, record_ts, round(u, 6) AS u, v, coalesce(n, 0) AS candidates FROM i LEFT JOIN m ON m.image_id = i.image_id AND rn = 1"""


def asof(spark, d, choice: str) -> DataFrame:
    e = table(spark, d, "events")
    images = e.where("event_type = 'click'").select(F.col("event_id").alias("image_id"), "ts")
    records = e.where("event_type = 'view'").select("ts", F.col("value").alias("u"), (F.col("event_id") % 17).cast("double").alias("v"))
    out = S.asof_in_window(images, records, "image_id", ["u", "v"], 1.0, choice)
    return out.select("image_id", "record_ts", r6("u").alias("u"), "v", "candidates")


@query("asof_wind_earliest", f"WITH {WIND.format(order='r.ts, u, v')}")
def asof_wind_earliest(spark, d):
    return asof(spark, d, "earliest")


@query("asof_wind_nearest", f"WITH {WIND.format(order='abs(epoch_us(r.ts) - epoch_us(i.ts)), r.ts, u, v')}")
def asof_wind_nearest(spark, d):
    return asof(spark, d, "nearest")


@query("detections_reviewed", "SELECT system_index, EXISTS (SELECT 1 FROM obs r WHERE r.event_type = 'signup' AND r.structure_id = o.structure_id AND r.system_index % 10 = o.system_index % 10) AS reviewed FROM obs o WHERE event_type = 'view'", "obs")
def detections_reviewed(spark, d):
    o = obs(spark, d).withColumn("k", F.col("system_index") % 10)
    return sinks.reviewed(o.where("event_type = 'view'"), o.where("event_type = 'signup'"), ["structure_id", "k"]).select("system_index", "reviewed")


ARTIFACTS = "art AS (SELECT s_suppkey AS sid, 'MBSP' AS datatype, CASE WHEN s_suppkey % 4 = 0 THEN 'ingesting' ELSE 'ready' END AS state FROM supplier WHERE s_suppkey % 3 <> 0)"


def artifacts(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").where("s_suppkey % 3 <> 0")
    return s.select(F.col("s_suppkey").alias("sid"), F.lit("MBSP").alias("datatype"), F.when(F.col("s_suppkey") % 4 == 0, "ingesting").otherwise("ready").alias("state"))


@query("export_decision", f"WITH {ARTIFACTS} SELECT s_suppkey AS sid, CASE WHEN state IS NULL THEN 'export' WHEN state = 'ingesting' THEN 'wait' ELSE 'skip' END AS decision FROM supplier LEFT JOIN art ON sid = s_suppkey")
def export_decision(spark, d):
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"), F.lit("MBSP").alias("datatype"))
    return sinks.export_decision(wanted, artifacts(spark, d)).select("sid", "decision")


@query("skip_existing", f"WITH {ARTIFACTS} SELECT l_suppkey AS sid, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT sid FROM art) GROUP BY 1")
def skip_existing(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sid"))
    return sinks.to_export(rows, artifacts(spark, d), "MBSP").groupBy("sid").agg(F.count("*").alias("n"))


@query("sites_update", "SELECT c_custkey AS row_index, CASE WHEN c_custkey % 4 = 0 THEN 'S' || c_custkey ELSE c_mktsegment END AS system_index FROM customer")
def sites_update(spark, d):
    c = table(spark, d, "customer")
    sites = c.select(F.col("c_custkey").alias("row_index"), F.col("c_mktsegment").alias("system_index"))
    updates = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("row_index"), F.concat(F.lit("S"), "c_custkey").alias("system_index"))
    unknown = updates.limit(1).select((F.col("row_index") - 10_000_000).alias("row_index"), "system_index")
    return sinks.updated_sites(sites, updates.unionByName(unknown))


@query("scene_cleanup", "SELECT l_suppkey AS sid, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1")
def scene_cleanup(spark, d):
    failed = table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("sid"))
    return sinks.without_scenes(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sid")), failed).groupBy("sid").agg(F.count("*").alias("n"))


@query("spatial_point_region_join", f"""
SELECT site_id, structure_id FROM site CROSS JOIN (SELECT structure_id, lon AS site_lon, lat AS site_lat FROM structure)
WHERE abs(lon - site_lon) <= 1 AND abs(lat - site_lat) <= 1 AND {DX} * {DX} + {DY} * {DY} <= 100000000E0""", "site", "structure")
def spatial_point_region_join(spark, d):
    met = S.metre_join(view(spark, d, "structure"), view(spark, d, "site"), 10_000.0)
    return met.select(F.col("o_site_id").alias("site_id"), "structure_id")


@query("box_join", "SELECT a.site_id, b.structure_id FROM site a JOIN structure b ON abs(a.lon - b.lon) <= 2 AND abs(a.lat - b.lat) <= 2", "site", "structure")
def box_join(spark, d):
    return S.grid_join(view(spark, d, "site"), view(spark, d, "structure"), 2.0).select("site_id", F.col("o_structure_id").alias("structure_id"))


@query("sites_in_polygon", "SELECT site_id FROM site WHERE lon > -120 AND lon < 60 AND lat > -30.03E0 AND lat < 45.02E0 AND NOT (lon >= -30.01E0 AND lat <= 10.01E0)", "site")
def sites_in_polygon(spark, d):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-120.0, -30.03), (-30.01, -30.03), (-30.01, 10.01), (60.0, 10.01), (60.0, 45.02), (-120.0, 45.02))))
    return view(spark, d, "site").where(S.point_in_ring(F.col("lon"), F.col("lat"), ring)).select("site_id")


@query("scenes_of_sites", """
WITH k AS (SELECT min(site_id) AS lo, count(*) AS n FROM site)
SELECT site_id, event_id AS sid FROM events CROSS JOIN k JOIN site ON lo + event_id % n = site_id AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'""", "site")
def scenes_of_sites(spark, d):
    every = view(spark, d, "site")
    sites = every.select(F.col("site_id").alias("row_index"), F.col("site_id").cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.lit("2024-01-05").cast("date").alias("start"), F.lit("2024-01-08").cast("date").alias("end_exclusive"), F.lit(None).cast("array<string>").alias("system_index"))
    place = (F.col("lo") + F.col("event_id") % F.col("n")).cast("double")
    events = table(spark, d, "events").join(F.broadcast(every.agg(F.min("site_id").alias("lo"), F.count("*").alias("n"))))  # one row
    scenes = events.select(F.col("event_id").cast("string").alias("sid"), F.col("ts").alias("sensing_ts"), place.alias("west"), place.alias("east"), F.lit(-1.0).alias("south"), F.lit(1.0).alias("north"))
    return readers.resolved_sites(sites, scenes).select(F.col("row_index").alias("site_id"), F.col("sid").cast("bigint").alias("sid"))


@query("group_ids", """
WITH RECURSIVE s AS (SELECT site_id, lon, lat, row_number() OVER (ORDER BY site_id) AS k FROM site),
walk(k, openers) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(lon DOUBLE, lat DOUBLE)[]) UNION ALL
  SELECT s.k, CASE WHEN len(list_filter(openers, lambda o: (s.lon - o.lon) * (s.lon - o.lon) + (s.lat - o.lat) * (s.lat - o.lat) <= 4E0)) > 0 THEN openers ELSE list_append(openers, {'lon': s.lon, 'lat': s.lat}) END FROM walk JOIN s ON s.k = walk.k + 1),
o AS (SELECT unnest(openers) AS o, unnest(range(1, len(openers) + 1)) AS number FROM (SELECT openers FROM walk ORDER BY k DESC LIMIT 1))
SELECT site_id AS ord, max(number) AS group_id FROM s JOIN o ON (s.lon - o.lon) * (s.lon - o.lon) + (s.lat - o.lat) * (s.lat - o.lat) <= 4E0 GROUP BY 1""", "site")
def group_ids(spark, d):
    return S.group_ids(view(spark, d, "site").withColumnRenamed("site_id", "ord"), buffer=1.0).select("ord", "group_id")


def members(o: DataFrame) -> DataFrame:
    o = o.groupBy("structure_id").agg(F.array_sort(F.collect_list("system_index")).alias("m"))
    return o.select("structure_id", F.array_join(F.transform("m", lambda x: x.cast("string")), ";").alias("members"))


@query("group_members", "SELECT structure_id, string_agg(CAST(system_index AS VARCHAR), ';' ORDER BY system_index) AS members FROM obs GROUP BY 1", "obs")
def group_members(spark, d):
    return members(obs(spark, d))


@query("points_kept", "SELECT structure_id, count(*) AS n FROM obs WHERE event_type <> 'click' GROUP BY 1", "obs")
def points_kept(spark, d):
    o = obs(spark, d).withColumn("x", F.when(F.col("event_type") != "click", F.col("lon")))
    return readers.points(o, "x", "lat").groupBy("structure_id").agg(F.count("point").alias("n"))


@query("default_where_missing", "SELECT system_index, CASE WHEN cloud_fraction = 0 THEN 100E0 ELSE cloud_fraction END AS cloud FROM obs", "obs")
def default_where_missing(spark, d):
    return obs(spark, d).select("system_index", X.defaulted("cloud_fraction", 100.0, zero_is_missing=True).alias("cloud"))


@query("review_features", """SELECT structure_id, '{"type":"Feature","geometry":null,"properties":{"structure_id":' || structure_id || '}}' AS feature FROM structure""", "structure")
def review_features(spark, d):
    s = view(spark, d, "structure").withColumn("geometry", F.lit(None).cast("string"))
    lines = sinks.feature_lines(s, "geometry", "structure_id")
    return lines.select(F.get_json_object("value", "$.properties.structure_id").cast("bigint").alias("structure_id"), F.col("value").alias("feature"))


@query("pixel_at_site", """
SELECT s.structure_id, (SELECT c.site_id FROM site c WHERE abs(c.lon - s.lon) <= 2 AND abs(c.lat - s.lat) <= 2 ORDER BY sqrt((c.lon - s.lon) * (c.lon - s.lon) + (c.lat - s.lat) * (c.lat - s.lat)), c.lat, c.lon, c.site_id LIMIT 1) AS site_id FROM structure s""", "site", "structure")
def pixel_at_site(spark, d):
    return S.sampled_at(view(spark, d, "site"), view(spark, d, "structure"), "structure_id", ["site_id"], 2.0)


@query("buffer_boxes", "SELECT site_id, round(lon - degrees(15000E0 / 6371000E0) / cos(radians(lat)), 6) AS west, round(lat - degrees(15000E0 / 6371000E0), 6) AS south, round(lon + degrees(15000E0 / 6371000E0) / cos(radians(lat)), 6) AS east, round(lat + degrees(15000E0 / 6371000E0), 6) AS north FROM site", "site")
def buffer_boxes(spark, d):
    return view(spark, d, "site").select("site_id", *[r6(c).alias(k) for k, c in X.buffer_box("lon", "lat", 15_000.0).items()])


@query("site_centroids", "SELECT site_id % 10 AS region, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM site GROUP BY 1", "site")
def site_centroids(spark, d):
    return view(spark, d, "site").groupBy((F.col("site_id") % 10).alias("region")).agg(r6(F.avg("lon")).alias("lon"), r6(F.avg("lat")).alias("lat"))


@query("box_filter", "SELECT site_id FROM site WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN -10 AND 30", "site")
def box_filter(spark, d):
    return view(spark, d, "site").where(M.inside_box("lon", "lat", -20.0, -10.0, 40.0, 30.0)).select("site_id")
