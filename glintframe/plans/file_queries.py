"""Queries through files: what a writer puts into the shared folder, its reader gives back. And joins of polygons."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import checkpointed, shared_folder
from ..functions import scalars as X
from ..operators import spatial as S
from ..sources import raster, readers, sinks
from .adapters import table, view
from .catalog import query, r6


def through(spark: SparkSession, steps) -> DataFrame:
    """`steps(folder)` over a folder of its own in the shared one, which goes once the result is checkpointed."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    out = checkpointed(steps(folder))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


SQUARE = [(-1.003, -1.003), (1.003, -1.003), (1.003, 1.003), (-1.003, 1.003)]
DIAMOND = [(-1.5, 0.0), (0.0, -1.5), (1.5, 0.0), (0.0, 1.5)]


def ringed(places: DataFrame, shape: list[tuple[float, float]]) -> DataFrame:
    """`places` with `ring`, the shape around (lon, lat)."""
    return places.withColumn("ring", F.array(*(F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y")) for x, y in shape)))


ALPHA = "CAST(o_custkey % 50 AS VARCHAR) AS tile_id, o_orderdate AS datetime, o_totalprice / 1E3 AS alpha"


@query("alpha_csv_by_month", f"SELECT tile_id, CAST(year(datetime) AS INT) AS y, CAST(month(datetime) AS INT) AS m, count(*) AS n, round(sum(alpha), 6) AS total FROM (SELECT {ALPHA} FROM orders) GROUP BY 1, 2, 3")
def alpha_csv_by_month(spark, d):
    """Angles written as CSV by year and month, read back with their schema."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("tile_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("datetime"), (F.col("o_totalprice") / 1e3).alias("alpha"))

    def steps(folder):
        sinks.write_csv_by_month(rows, folder, "datetime", "tile_id", "datetime", "alpha")
        return readers.read_alpha(spark, f"{folder}/*/*").groupBy("tile_id", F.year("datetime").alias("y"), F.month("datetime").alias("m")).agg(F.count("*").alias("n"), r6(F.sum("alpha")).alias("total"))

    return through(spark, steps)


@query("tile_stats_csv", "SELECT tile_id, count(*) AS n, round(min(alpha), 6) AS alpha_min, round(max(alpha), 6) AS alpha_max FROM (SELECT " + ALPHA + " FROM orders) GROUP BY 1")
def tile_stats_csv(spark, d):
    """Statistics of each tile written as CSV and read back."""
    stats = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).cast("string").alias("tile_id")).agg(
        F.count("*").alias("n"), F.min(F.col("o_totalprice") / 1e3).alias("alpha_min"), F.max(F.col("o_totalprice") / 1e3).alias("alpha_max"))

    def steps(folder):
        sinks.write_csv(stats, folder)
        back = spark.read.schema("tile_id string, n long, alpha_min double, alpha_max double").csv(folder, header=True)
        return back.select("tile_id", "n", r6("alpha_min").alias("alpha_min"), r6("alpha_max").alias("alpha_max"))

    return through(spark, steps)


@query("features_read_back", """
SELECT structure_id, CASE WHEN structure_id % 3 <> 0 THEN round(lon, 6) END AS lon, CASE WHEN structure_id % 3 <> 0 THEN round(lat, 6) END AS lat FROM structure""", "structure")
def features_read_back(spark, d):
    """Feature files, one a structure, listed and read back; every third has no geometry."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    rows = view(spark, d, "structure").withColumn("geometry", F.when(F.col("structure_id") % 3 != 0, point))

    def steps(folder):
        lines = sinks.feature_lines(rows, "geometry", "structure_id").withColumn("part", F.get_json_object("value", "$.properties.structure_id"))
        whole = lines.groupBy((F.col("part").cast("long") % 16).alias("part")).agg(F.array_join(F.collect_list("value"), ",").alias("features"))
        whole.select("part", F.concat(F.lit('{"type":"FeatureCollection","features":['), "features", F.lit("]}")).alias("value")).write.partitionBy("part").text(folder)
        back = readers.read_features(spark, f"{folder}/*")
        at = lambda k: F.get_json_object("geometry", f"$.coordinates[{k}]").cast("double")
        return back.select(F.get_json_object("properties", "$.structure_id").cast("long").alias("structure_id"), r6(at(0)).alias("lon"), r6(at(1)).alias("lat"))

    return through(spark, steps)


@query("artifacts_ensured", """
SELECT sid, count(*) AS n, round(sum(b11), 6) AS total FROM px WHERE sid % 5 <> 0 GROUP BY sid""", "px")
def artifacts_ensured(spark, d):
    """Pixels of the scenes whose artifact is missing, made, written and read back; every fifth is ready."""
    p = view(spark, d, "px").select("sid", "row", "col", "b11")
    wanted = p.select("sid").distinct().withColumn("datatype", F.lit("SGA"))
    ready = wanted.where("sid % 5 = 0").withColumn("state", F.lit("ready"))

    def steps(folder):
        done = sinks.ensured(wanted, ready, lambda sids: p.join(sids, "sid", "left_semi"), folder)
        back = spark.read.parquet(folder).withColumn("sid", F.col("sid").cast("long"))
        return back.join(done.where("exported").select("sid"), "sid", "left_semi").groupBy("sid").agg(F.count("*").alias("n"), r6(F.sum("b11")).alias("total"))

    return through(spark, steps)


@query("raster_files", """
SELECT sid, "row" AS i, col AS j, CAST(sga AS DOUBLE) AS sga, 'EPSG:32615' AS crs FROM px WHERE "row" < 20 AND col < 20""", "px")
def raster_files(spark, d):
    """Angle grids of each scene as tiled GeoTIFF bytes with a CRS, decoded again."""
    p = view(spark, d, "px").where("row < 20 and col < 20").select("sid", F.col("row").alias("i"), F.col("col").alias("j"), "sga", F.lit("EPSG:32615").alias("crs"))
    files = raster.grid_files(p, "sga")
    return raster.decoded_grids(files)


@query("polygons_meeting", """
SELECT site_id, structure_id FROM site a JOIN structure b ON greatest(abs(a.lon - b.lon) - 1.003E0, 0) + greatest(abs(a.lat - b.lat) - 1.003E0, 0) <= 1.5E0""", "site", "structure")
def polygons_meeting(spark, d):
    """Squares around sites that meet diamonds around structures."""
    return S.ring_join(ringed(view(spark, d, "site"), SQUARE), ringed(view(spark, d, "structure"), DIAMOND), 3.0).select("site_id", F.col("o_structure_id").alias("structure_id"))


@query("sites_in_polygons", """
SELECT site_id, structure_id FROM site a JOIN structure b ON abs(a.lon - b.lon) + abs(a.lat - b.lat) < 1.505E0""", "site", "structure")
def sites_in_polygons(spark, d):
    shape = [(x * 1.505 / 1.5, y * 1.505 / 1.5) for x, y in DIAMOND]
    return S.points_in_rings(view(spark, d, "site"), ringed(view(spark, d, "structure"), shape), 3.0).select("site_id", F.col("o_structure_id").alias("structure_id"))


@query("pixel_places", """
SELECT sid, "row" AS grid_row, col AS grid_col, round(-90E0 + (col + 0.5E0) * 2E-4, 7) AS x, round(27E0 - ("row" + 0.5E0) * 2E-4, 7) AS y FROM px""", "px")
def pixel_places(spark, d):
    """Centres of the pixels of a grid of 24 columns and 1000 rows in its box."""
    x, y = X.pixel_place("row", "col", F.lit(-90.0), F.lit(27.0), F.lit(-90.0 + 24 * 2e-4), F.lit(27.0 - 1000 * 2e-4), F.lit(1000), F.lit(24))
    return view(spark, d, "px").select("sid", F.col("row").alias("grid_row"), F.col("col").alias("grid_col"), F.round(x, 7).alias("x"), F.round(y, 7).alias("y"))
