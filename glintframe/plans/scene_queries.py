"""Queries on scenes: filters, glint products, catalogue and text operators, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import masks as M
from ..operators.timeline import first_row, histogram, placed, sampled_keys
from ..sources import readers, sinks
from .adapters import table, view
from .catalog import ALPHA, ANGLE, query, r6


def scenes(spark, d) -> DataFrame:
    return view(spark, d, "scene")


def alpha() :
    return X.glint_alpha("sza", "saa", "vza_b11", "vza_b12", "vaa_b11", "vaa_b12")


def with_alpha(spark, d) -> DataFrame:
    return scenes(spark, d).withColumn("alpha", F.round(alpha(), 9)).where(F.col("alpha").isNotNull())


A = f"a AS (SELECT *, round({ALPHA}, 9) AS alpha FROM scene WHERE sza IS NOT NULL AND saa IS NOT NULL)"


@query("scene_cloud_date_filter", "SELECT sid, cloudy_pixel_pct FROM scene WHERE cloudy_pixel_pct < 50 AND sensing_ts >= TIMESTAMP '1995-01-01' AND sensing_ts < TIMESTAMP '1996-01-01'", "scene")
def scene_cloud_date_filter(spark, d):
    return scenes(spark, d).where(M.scene_cloud_ok() & M.between_days("sensing_ts", "1995-01-01", "1996-01-01")).select("sid", "cloudy_pixel_pct")


@query("scene_sga_filter", f"SELECT sid, round({ANGLE}, 6) AS angle FROM scene WHERE sza IS NULL OR vza_b11 IS NULL OR coalesce({ANGLE} > 0 AND {ANGLE} < 40, true)", "scene")
def scene_sga_filter(spark, d):
    return M.scenes_in_glint(scenes(spark, d)).select("sid", r6("angle").alias("angle"))


@query("alpha_abc", f"SELECT sid, round({ALPHA}, 6) AS alpha FROM scene", "scene")
def alpha_abc(spark, d):
    return scenes(spark, d).select("sid", r6(alpha()).alias("alpha"))


@query("angles_known", "SELECT sid FROM scene WHERE sza IS NOT NULL AND saa IS NOT NULL AND vza_b11 IS NOT NULL AND vaa_b11 IS NOT NULL AND vza_b12 IS NOT NULL AND vaa_b12 IS NOT NULL", "scene")
def angles_known(spark, d):
    return scenes(spark, d).where(M.angles_known()).select("sid")


@query("angles_positive", "SELECT sid FROM scene WHERE sza > 0 AND saa > 0 AND vza_b11 > 0 AND vaa_b11 > 0 AND vza_b12 > 0 AND vaa_b12 > 0", "scene")
def angles_positive(spark, d):
    return scenes(spark, d).where(M.angles_positive()).select("sid")


@query("scene_lookup", "SELECT sid, tile FROM scene WHERE sid = (SELECT min(sid) FROM scene)", "scene")
def scene_lookup(spark, d):
    s = scenes(spark, d)
    return s.join(F.broadcast(s.agg(F.min("sid").alias("sid"))), "sid", "left_semi").select("sid", "tile")  # one row


@query("time_series_projection", f"WITH {A} SELECT tile AS tile_id, sensing_ts AS datetime, round(alpha, 6) AS alpha FROM a", "scene")
def time_series_projection(spark, d):
    return with_alpha(spark, d).select(F.col("tile").alias("tile_id"), F.col("sensing_ts").alias("datetime"), r6("alpha").alias("alpha"))


@query("scenes_by_alpha_missing_last", f"WITH x AS (SELECT sid, round({ALPHA}, 6) AS alpha FROM scene) SELECT sid, alpha, row_number() OVER (ORDER BY alpha ASC NULLS LAST, sid) AS place FROM x", "scene")
def scenes_by_alpha_missing_last(spark, d):
    return placed(scenes(spark, d).select("sid", r6(alpha()).alias("alpha")), F.asc_nulls_last("alpha"), F.asc("sid"))


@query("nth_scene", "SELECT sid, cloudy_pixel_pct FROM scene ORDER BY cloudy_pixel_pct, sensing_ts, sid OFFSET 3 LIMIT 1", "scene")
def nth_scene(spark, d):
    return readers.nth(scenes(spark, d), 3, "cloudy_pixel_pct", "sensing_ts", "sid").select("sid", "cloudy_pixel_pct")


@query("tile_alpha_stats", f"WITH {A} SELECT tile, round(min(alpha), 6) AS alpha_min, round(max(alpha), 6) AS alpha_max, round(avg(alpha), 6) AS alpha_mean, count(*) AS n FROM a GROUP BY tile", "scene")
def tile_alpha_stats(spark, d):
    return with_alpha(spark, d).groupBy("tile").agg(r6(F.min("alpha")).alias("alpha_min"), r6(F.max("alpha")).alias("alpha_max"), r6(F.avg("alpha")).alias("alpha_mean"), F.count("*").alias("n"))


@query("tile_stats_below_limit", f"WITH {A} SELECT tile, round(max(alpha), 6) AS alpha_max FROM a GROUP BY tile HAVING max(alpha) < 79", "scene")
def tile_stats_below_limit(spark, d):
    return with_alpha(spark, d).groupBy("tile").agg(F.max("alpha").alias("alpha_max")).where("alpha_max < 79").select("tile", r6("alpha_max").alias("alpha_max"))


@query("alpha_minmax_composite", f"WITH {A} SELECT date_trunc('month', sensing_ts) AS month_start, tile, round(min(alpha), 6) AS alpha_min, round(max(alpha), 6) AS alpha_max FROM a WHERE cloudy_pixel_pct < 20 GROUP BY 1, 2", "scene")
def alpha_minmax_composite(spark, d):
    s = with_alpha(spark, d).where(M.scene_cloud_ok(most=20)).withColumn("month_start", F.date_trunc("month", "sensing_ts").cast("timestamp_ntz"))
    return s.groupBy("month_start", "tile").agg(r6(F.min("alpha")).alias("alpha_min"), r6(F.max("alpha")).alias("alpha_max"))


@query("composite_names", "SELECT DISTINCT lower(strftime(sensing_ts, '%B')) || strftime(sensing_ts, '%Y') || '_sunglintAlpha_min' AS name FROM scene", "scene")
def composite_names(spark, d):
    return scenes(spark, d).select(sinks.composite_name("sensing_ts", "min").alias("name")).distinct()


@query("argmax_per_tile", f"WITH {A} SELECT tile, sid, round(alpha, 6) AS alpha FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY alpha DESC, sensing_ts, sid) AS rn FROM a) WHERE rn = 1", "scene")
def argmax_per_tile(spark, d):
    return first_row(with_alpha(spark, d), ["tile"], F.desc("alpha"), F.col("sensing_ts"), F.col("sid")).select("tile", "sid", r6("alpha").alias("alpha"))


@query("argmin_per_tile", f"WITH {A} SELECT tile, sid, round(alpha, 6) AS alpha FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY alpha, sensing_ts, sid) AS rn FROM a) WHERE rn = 1", "scene")
def argmin_per_tile(spark, d):
    return first_row(with_alpha(spark, d), ["tile"], F.col("alpha"), F.col("sensing_ts"), F.col("sid")).select("tile", "sid", r6("alpha").alias("alpha"))


@query("alpha_histogram", """
WITH v AS (SELECT sid, cloudy_pixel_pct * 3E0 + tile AS x FROM scene), e AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(least(floor((x - lo) * 100 / (hi - lo)), 99) AS INT) AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT CAST(k AS INT) AS bin, coalesce(n, 0) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY k) AS BIGINT) AS cumulative FROM range(100) t(k) LEFT JOIN b ON b.bin = k""", "scene")
def alpha_histogram(spark, d):
    v = scenes(spark, d).select((F.col("cloudy_pixel_pct") * 3.0 + F.col("tile")).alias("x"))
    return histogram(v, "x", 100).select("bin", "n", "cumulative")


@query("tile_prefix_group", "SELECT substr(CAST(tile AS VARCHAR), 1, 1) AS prefix, count(*) AS n, count(DISTINCT tile) AS n_tiles FROM scene GROUP BY 1", "scene")
def tile_prefix_group(spark, d):
    return scenes(spark, d).groupBy(F.substring(F.col("tile").cast("string"), 1, 1).alias("prefix")).agg(F.count("*").alias("n"), F.countDistinct("tile").alias("n_tiles"))


@query("value_counts", "SELECT tile, count(*) AS n FROM scene GROUP BY tile", "scene")
def value_counts(spark, d):
    return scenes(spark, d).groupBy("tile").agg(F.count("*").alias("n"))


def sorted_ids(s: DataFrame) -> DataFrame:
    s = s.groupBy("tile").agg(F.array_sort(F.collect_set("sid")).alias("sids"))
    return s.select("tile", F.array_join(F.transform("sids", lambda x: x.cast("string")), ",").alias("sids"))


@query("distinct_sorted_ids", "SELECT tile, string_agg(CAST(sid AS VARCHAR), ',' ORDER BY sid) AS sids FROM (SELECT DISTINCT tile, sid FROM scene) GROUP BY tile", "scene")
def distinct_sorted_ids(spark, d):
    return sorted_ids(scenes(spark, d))


@query("sampled_tiles", """
WITH t AS (SELECT tile, row_number() OVER (ORDER BY md5(CAST(tile AS VARCHAR) || ':6'), tile) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT tile FROM scene))
SELECT sid, tile FROM scene WHERE tile IN (SELECT tile FROM t WHERE place <= greatest(1, n // 1000))""", "scene")
def sampled_tiles(spark, d):
    """Scenes of a repeatable sample of tiles, met by a semi-join."""
    s = scenes(spark, d)
    return s.join(sampled_keys(s, "tile"), "tile", "left_semi").select("sid", "tile")


@query("monthly_fan_out", f"WITH {A} SELECT CAST(year(sensing_ts) AS INT) AS y, CAST(month(sensing_ts) AS INT) AS m, count(*) AS n, round(avg(alpha), 6) AS alpha_mean FROM a GROUP BY 1, 2", "scene")
def monthly_fan_out(spark, d):
    return with_alpha(spark, d).groupBy(F.year("sensing_ts").alias("y"), F.month("sensing_ts").alias("m")).agg(F.count("*").alias("n"), r6(F.avg("alpha")).alias("alpha_mean"))


# -- ids and text ----------------------------------------------------------------------------------

SIDS = "sids AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || CASE WHEN o_orderkey % 10 = 3 THEN '_t15rxl' ELSE '_T' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || 'RXL' END AS sid FROM orders)"


def sids(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    t = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")
    tile = F.when(F.col("o_orderkey") % 10 == 3, "_t15rxl").otherwise(F.concat(F.lit("_T"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lit("RXL")))
    return o.select(F.col("o_orderkey").alias("k"), F.concat(t, F.lit("_"), t, tile).alias("sid"))


@query("sid_parse", f"WITH {SIDS} SELECT k, nullif(regexp_extract(sid, '^(\\d{{8}}T\\d{{6}})_(\\d{{8}}T\\d{{6}})_T(\\d{{2}}[A-Z]{{3}})$', 1), '') AS start_text, nullif(regexp_extract(sid, '^(\\d{{8}}T\\d{{6}})_(\\d{{8}}T\\d{{6}})_T(\\d{{2}}[A-Z]{{3}})$', 3), '') AS tile FROM sids")
def sid_parse(spark, d):
    p = sids(spark, d).withColumn("p", X.parse_sid("sid"))
    return p.select("k", F.col("p.start").alias("start_text"), F.col("p.tile").alias("tile"))


@query("xml_address", f"WITH {SIDS} SELECT k, 'tiles/' || substr(split_part(sid, '_', 3), 2, 2) || '/' || substr(split_part(sid, '_', 3), 4, 1) || '/' || substr(split_part(sid, '_', 3), 5, 2) || '/P' || k || '.SAFE/GRANULE/G' || k || '/MTD_TL.xml' AS address FROM sids")
def xml_address(spark, d):
    s = sids(spark, d).withColumn("product_id", F.concat(F.lit("P"), "k")).withColumn("granule_id", F.concat(F.lit("G"), "k"))
    return s.select("k", X.xml_address("sid", "product_id", "granule_id").alias("address"))


@query("catalogue_pick", """
WITH c AS (SELECT o_orderkey AS uuid, o_custkey % 40 AS k, o_orderdate AS start, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 END AS lvl FROM orders)
SELECT k, uuid FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY lvl, start DESC, uuid) AS rn FROM c WHERE lvl IS NOT NULL) WHERE rn = 1""")
def catalogue_pick(spark, d):
    o = table(spark, d, "orders")
    status, key = F.col("o_orderstatus"), F.lpad((F.col("o_custkey") % 40).cast("string"), 2, "0")
    level = F.when(status == "F", "MSIL1C").when(status == "O", "MSIL2A").otherwise("OTHER")
    names = o.select(F.col("o_orderkey").alias("uuid"), F.concat(F.lit("S2A_"), level, F.lit("_20200101T000000_N0500_T"), key, F.lit("RXL_X.SAFE")).alias("name"), F.col("o_orderdate").alias("start"))
    wanted = o.select(F.concat(F.lit("20200101T000000_20200101T000000_T"), key, F.lit("RXL")).alias("sid")).distinct()
    picked = readers.catalogue_pick(names, wanted)
    return picked.select(X.parse_sid("sid")["tile"].substr(1, 2).cast("bigint").alias("k"), "uuid")


@query("coordinate_suffix", "SELECT site_id, printf('%.3f_%.3f', lon, lat) AS suffix FROM site", "site")
def coordinate_suffix(spark, d):
    return view(spark, d, "site").select("site_id", X.coordinate_suffix("lon", "lat").alias("suffix"))


@query("json_first_point", """
SELECT site_id, CASE WHEN site_id % 3 = 2 THEN NULL ELSE round(lon, 4) END AS lon, CASE WHEN site_id % 3 = 2 THEN NULL ELSE round(lat, 4) END AS lat FROM site""", "site")
def json_first_point(spark, d):
    pair = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(", "), F.col("lat").cast("string"), F.lit("]"))
    text = F.when(F.col("site_id") % 3 == 0, pair).when(F.col("site_id") % 3 == 1, F.concat(F.lit("["), pair, F.lit(", [1, 2]]"))).otherwise("[]")
    return view(spark, d, "site").withColumn("p", X.first_point(text)).select("site_id", F.round("p.lon", 4).alias("lon"), F.round("p.lat", 4).alias("lat"))


@query("geojson_or_wkt_point", "SELECT site_id, CASE WHEN site_id % 4 = 3 THEN NULL ELSE round(lon, 4) END AS lon, CASE WHEN site_id % 4 = 3 THEN NULL ELSE round(lat, 4) END AS lat FROM site", "site")
def geojson_or_wkt_point(spark, d):
    s = view(spark, d, "site")
    geojson = F.when(F.col("site_id") % 4 < 2, F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]}")))
    wkt = F.when(F.col("site_id") % 4 == 2, F.concat(F.lit("POINT ("), F.format_string("%.6f", "lon"), F.lit(" "), F.format_string("%.6f", "lat"), F.lit(")"))).otherwise("LINESTRING (0 0, 1 1)")
    return s.withColumn("g", geojson).withColumn("w", wkt).withColumn("p", X.point_of("g", "w")).select("site_id", F.round("p.lon", 4).alias("lon"), F.round("p.lat", 4).alias("lat"))


@query("listed_ids", "SELECT site_id, CAST(len(list_filter(list_transform(string_split(' a' || site_id || '; ;b;', ';'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS n, 'a' || site_id AS first_id FROM site", "site")
def listed_ids(spark, d):
    s = view(spark, d, "site").withColumn("ids", X.listed(F.concat(F.lit(" a"), "site_id", F.lit("; ;b;"))))
    return s.select("site_id", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first_id"))


@query("number_list", "SELECT site_id, CAST(3 AS INT) AS n, round(lon + lat, 3) AS total FROM site", "site")
def number_list(spark, d):
    s = view(spark, d, "site").withColumn("v", X.numbers(F.concat_ws(" ", F.format_string("%.9f", "lon"), F.lit("NaN"), F.format_string("%.9f", "lat"))))
    return s.select("site_id", F.size("v").alias("n"), F.round(F.col("v")[0] + F.col("v")[2], 3).alias("total"))


@query("date_parts", "SELECT sid, strftime(sensing_ts + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day, strftime(sensing_ts + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, lower(strftime(sensing_ts, '%B')) AS month_name FROM scene", "scene")
def date_parts(spark, d):
    day = F.to_date("sensing_ts")
    return scenes(spark, d).select("sid", F.date_format(F.date_add(day, 1), "yyyy-MM-dd").alias("next_day"), F.date_format(F.add_months(day, 1), "yyyy-MM-dd").alias("next_month"), X.month_name("sensing_ts").alias("month_name"))


@query("parsed_days", "SELECT sid, CASE WHEN sid % 5 = 0 THEN NULL ELSE strftime(sensing_ts, '%Y-%m-%d') END AS day FROM scene", "scene")
def parsed_days(spark, d):
    text = F.when(F.col("sid") % 5 == 0, "2024-xx").otherwise(F.date_format("sensing_ts", "yyyyMMdd"))
    return scenes(spark, d).select("sid", F.date_format(X.day_of(text), "yyyy-MM-dd").alias("day"))


@query("mercator_roundtrip", "SELECT site_id, round(radians(lon) * 6378137E0, 3) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137E0, 3) + 0E0 AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM site", "site")
def mercator_roundtrip(spark, d):
    x, y = X.to_mercator("lon", "lat")
    s = view(spark, d, "site").select("site_id", x.alias("x"), y.alias("y"))
    lon, lat = X.from_mercator("x", "y")
    return s.select("site_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), r6(lon).alias("lon"), r6(lat).alias("lat"))


# -- similarity ------------------------------------------------------------------------------------

WEIGHTS = [1.0, 0.5, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0, 0.25, 1.0, 1.0, 0.75, 3.0]
_REF = """WITH v AS (SELECT vec_id, list_transform(embedding[1:13], lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), w AS (SELECT [1.0::DOUBLE, 0.5, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0, 0.25, 1.0, 1.0, 0.75, 3.0] AS w), r AS (SELECT x AS r FROM v WHERE vec_id = 0)"""


def band_vectors(spark, d) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 13).alias("x"))
    ref = v.where("vec_id = 0").limit(1).select(F.col("x").alias("ref"))  # one row, so a broadcast of one row
    return v.join(F.broadcast(ref))


@query("weighted_cosine", f"""{_REF}
SELECT vec_id, round(s.xr / (sqrt(s.xx) * sqrt(s.rr)), 6) AS wcos FROM (SELECT vec_id, list_sum([w[i] * x[i] * r[i] for i in range(1, 14)]) AS xr, list_sum([w[i] * x[i] * x[i] for i in range(1, 14)]) AS xx, list_sum([w[i] * r[i] * r[i] for i in range(1, 14)]) AS rr FROM v, w, r) s""")
def weighted_cosine(spark, d):
    w = F.array(*map(F.lit, WEIGHTS))
    return band_vectors(spark, d).select("vec_id", r6(X.weighted_cosine("x", "ref", w)).alias("wcos"))


@query("weighted_distance", f"""{_REF}
SELECT vec_id, round(sqrt(list_sum([w[i] * (x[i] - r[i]) * (x[i] - r[i]) for i in range(1, 14)])), 6) AS wdist FROM v, w, r""")
def weighted_distance(spark, d):
    w = F.array(*map(F.lit, WEIGHTS))
    return band_vectors(spark, d).select("vec_id", r6(X.weighted_distance("x", "ref", w)).alias("wdist"))
