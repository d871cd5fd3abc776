"""Readers of the workflow's inputs as DataFrames with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import coordinate_suffix, day_of, first_point, listed, numbers, parse_sid, point_of, xml_address

SITE_FIELDS = "lon DOUBLE, lat DOUBLE, start STRING, end STRING, system_index STRING"
ALPHA_SCHEMA = "tile_id STRING, datetime TIMESTAMP_NTZ, alpha DOUBLE"
OBSERVATION_SCHEMA = "system_index STRING, cloud_fraction DOUBLE, min_ndwi DOUBLE, structure_present INT, max_tai DOUBLE, flare_present INT, flare_latlon STRING, geojson STRING, wkt STRING, structure_id BIGINT"


def read_sites(spark: SparkSession, path: str, keep: list[int] | None = None, default_start: str = "2017-01-01", default_site: dict | None = None) -> DataFrame:
    """row_index, lon, lat, start, end_exclusive, system_index array; index 0 is the first data row.

    The last day counts, so end moves one day on. Columns the header lacks, and empty cells, take the
    defaults. Without a path the single default site stands in, with row_index -1.
    """
    if not path:
        s = default_site or {"lon": 0.0, "lat": 0.0, "start": default_start, "end": default_start}
        rows = spark.createDataFrame([(-1, s["lon"], s["lat"], s["start"], s["end"], None)], "row_index int, lon double, lat double, start string, end string, system_index string")
    else:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.col("value"), r"\r?\n")).alias("line", "text")).where("trim(text) != ''")
        header = [c.strip() for c in lines.where("line = 0").first()["text"].split(",")]
        schema = ", ".join(f"`{c}` STRING" for c in header)
        rows = lines.where("line > 0").select((F.row_number().over(Window.orderBy("line")) - 1).alias("row_index"), F.from_csv("text", schema).alias("r")).select("row_index", "r.*")
        for c in ("lon", "lat", "start", "end", "system_index"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
    if keep is not None and path:
        rows = rows.where(F.col("row_index").isin(keep))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    start = F.coalesce(blank("start"), F.lit(default_start)).cast("date")
    return rows.select("row_index", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), start.alias("start"),
                       F.date_add(F.coalesce(blank("end").cast("date"), start), 1).alias("end_exclusive"), listed("system_index").alias("system_index"))


def scenes_between(scenes: DataFrame, lon: float, lat: float, start: str, end: str) -> DataFrame:
    """Scenes of [start, end) whose footprint box holds the point; date and box reach the scan."""
    return scenes.where((F.col("sensing_ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("sensing_ts") < F.lit(end).cast("timestamp_ntz"))
                        & (F.col("west") <= lon) & (F.col("east") >= lon) & (F.col("south") <= lat) & (F.col("north") >= lat))


def scene(scenes: DataFrame, sid: str) -> DataFrame:
    return scenes.where(F.col("sid") == sid).limit(1)


SMALLEST, LARGEST = -7, 9  # cells of 1/128 to 512 degrees


def _cell(value: Column, level: Column) -> Column:
    """The cell of a coordinate; above the largest size there is one cell."""
    return F.when(level > LARGEST, F.lit(0).cast("long")).otherwise(F.floor(value / F.pow(F.lit(2.0), level)))


def resolved_sites(sites: DataFrame, scenes: DataFrame) -> DataFrame:
    """row_index, sid of every site: its cached ids as they are, else the scenes of its dates and place."""
    cached = sites.where(F.size("system_index") > 0).select("row_index", F.explode("system_index").alias("sid"))
    open_ = sites.where(F.coalesce(F.size("system_index"), F.lit(0)) <= 0)
    near = (F.col("sensing_ts") >= F.col("start").cast("timestamp_ntz")) & (F.col("sensing_ts") < F.col("end_exclusive").cast("timestamp_ntz"))
    near = near & F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    # One key for each day the site asks for, and for its place, turns the interval join into an equi-join. A footprint lies
    # on the grid whose cells are as large as it is, so in few of them; a site looks into its cell of each grid in use.
    days = open_.withColumn("day", F.explode(F.when(F.col("end_exclusive") > F.col("start"), F.sequence(F.col("start"), F.date_sub("end_exclusive", 1)))))
    extent = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    level = F.when(extent <= 2.0**SMALLEST, SMALLEST).when(extent <= 2.0**LARGEST, F.ceil(F.log2(extent))).otherwise(LARGEST + 1).cast("int")
    span = lambda low, high: F.explode(F.sequence(_cell(F.col(low), F.col("__level")), _cell(F.col(high), F.col("__level"))))
    seen = scenes.where((F.col("west") <= F.col("east")) & (F.col("south") <= F.col("north"))).withColumn("__level", level)
    levels = F.broadcast(seen.select("__level").distinct())  # a row per size
    seen = seen.withColumn("day", F.to_date("sensing_ts")).withColumn("__i", span("west", "east")).withColumn("__j", span("south", "north"))
    looked = days.join(levels).withColumn("__i", _cell(F.col("lon"), F.col("__level"))).withColumn("__j", _cell(F.col("lat"), F.col("__level")))
    found = looked.join(seen, ["day", "__level", "__i", "__j"]).where(near).select("row_index", "sid")
    return cached.unionByName(found).distinct()


def granule_angles(spark: SparkSession, paths: str) -> DataFrame:
    """sid (file name), kind, i, j, value of sun and per-detector view grids of granule XML, NaN as NULL.

    kind: sun_zenith, sun_azimuth, view_zenith, view_azimuth (band id 12, one row for each detector).
    """
    xml = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("sid"), F.col("value").alias("xml"))
    sun = [(f"sun_{k.lower()}", f"//Sun_Angles_Grid/{k}/Values_List/VALUES/text()") for k in ("Zenith", "Azimuth")]
    view = [(f"view_{k.lower()}", f"//Viewing_Incidence_Angles_Grids[@bandId='12']/{k}/Values_List/VALUES/text()") for k in ("Zenith", "Azimuth")]
    lines = F.array(*(F.struct(F.lit(kind).alias("kind"), F.xpath("xml", F.lit(path)).alias("rows")) for kind, path in sun + view))
    g = xml.select("sid", F.explode(lines).alias("g")).select("sid", "g.kind", F.posexplode("g.rows").alias("line", "text"))
    g = g.withColumn("size", F.size(numbers("text"))).where("size > 0")  # grids are square: line of all detectors -> row
    return g.select("sid", "kind", F.pmod("line", "size").alias("i"), F.floor(F.col("line") / F.col("size")).cast("int").alias("detector"), F.posexplode(numbers("text")).alias("j", "value"))


def granule_corner(spark: SparkSession, paths: str) -> DataFrame:
    """sid, ulx, uly, crs of granule XML."""
    xml = spark.read.text(paths, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("sid"), F.col("value").alias("xml"))
    return xml.select("sid", F.xpath_double("xml", F.lit("//Geoposition/ULX")).alias("ulx"), F.xpath_double("xml", F.lit("//Geoposition/ULY")).alias("uly"), F.xpath_string("xml", F.lit("//HORIZONTAL_CS_CODE")).alias("crs"))


def catalogue_pick(catalogue: DataFrame, sids: DataFrame, prefer_l2a: bool = False) -> DataFrame:
    """sid, uuid: of the products whose name holds the scene's start, tile and level, the latest of the first level.

    catalogue: uuid, name, start. Names carry the tile token, which is the join key.
    """
    c = catalogue.withColumn("tile", F.regexp_extract("name", r"_T(\d{2}[A-Z]{3})_", 1)).withColumn("sensed", F.regexp_extract("name", r"_(\d{8}T\d{6})_", 1))
    level = F.when(F.col("name").contains("MSIL2A"), 0 if prefer_l2a else 1).when(F.col("name").contains("MSIL1C"), 1 if prefer_l2a else 0)
    s = sids.withColumn("p", parse_sid("sid")).select("sid", F.col("p.tile").alias("tile"), F.col("p.start").alias("sensed"))
    met = s.join(c.withColumn("level_rank", level).where("level_rank is not null"), ["tile", "sensed"])
    w = Window.partitionBy("sid").orderBy("level_rank", F.desc("start"), "uuid")
    return met.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("sid", "uuid", "name")


def listed_nodes(responses: DataFrame) -> DataFrame:
    """node names of a catalogue response in any of its three JSON shapes: value, result, d.results."""
    node = "array<struct<Name: string, Id: string>>"
    j = F.from_json("body", f"value {node}, result {node}, d struct<results: {node}>")
    return responses.select("uri", F.explode(F.coalesce(j["value"], j["result"], j["d"]["results"])).alias("n")).select("uri", F.col("n.Name").alias("name"), F.col("n.Id").alias("id"))


def listed_files(spark: SparkSession, root: str, glob: str = "*.geojson") -> DataFrame:
    """system_index, datatype, lon, lat, path, size of files <sid>/<sid>_<TYPE>_<lon>_<lat>.geojson, exactly two parts deep."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    base = F.lit(root.rstrip("/"))
    tail = F.regexp_replace(F.element_at(F.split(F.col("path"), base), -1), "^/", "")
    f = files.withColumn("parts", F.split(tail, "/")).where(F.size("parts") == 2)
    name = F.regexp_replace(F.col("parts")[1], r"\.geojson$", "")
    rest = F.regexp_replace(name, F.concat(F.lit("^"), F.col("parts")[0], F.lit("_")), "")
    f = f.withColumn("sid", F.col("parts")[0]).withColumn("rest", F.split(rest, "_"))
    return f.where(name.startswith(F.col("sid")) & (F.size("rest") >= 3)).select(
        F.col("sid").alias("system_index"), F.col("rest")[0].alias("datatype"), F.col("rest")[1].alias("lon"), F.col("rest")[2].alias("lat"), "path", "size")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """path, geometry (JSON text, NULL for no plume), properties (JSON text) of each feature of GeoJSON files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("v"))
    one = F.try_variant_get("v", "$.type", "string") == "Feature"
    many = text.select("path", F.explode(F.when(one, F.array(F.col("v"))).otherwise(F.try_variant_get("v", "$.features", "array<variant>"))).alias("f"))
    part = lambda k: F.to_json(F.try_variant_get("f", f"$.{k}", "variant"))
    return many.select("path", F.nullif(part("geometry"), F.lit("null")).alias("geometry"), part("properties").alias("properties"))


def parsed_observations(obs: DataFrame) -> DataFrame:
    """Observations with granule_date, first flare point and site point (GeoJSON, else WKT); clear ones with a flare list.

    obs as OBSERVATION_SCHEMA.
    """
    p = obs.withColumn("granule_date", day_of(F.substring("system_index", 1, 8))).withColumn("flare_point", first_point("flare_latlon")).withColumn("point", point_of("geojson", "wkt"))
    return p


def clear_flares(obs: DataFrame, cloud_below: float = 15.0) -> DataFrame:
    return obs.where((F.col("cloud_fraction") < cloud_below) & F.col("flare_point").isNotNull())


def read_alpha(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALPHA_SCHEMA).csv(path, header=True)


def points(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """`df` with a point struct; rows without both coordinates go."""
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("point", F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")))


def nth(df: DataFrame, k: int, *order) -> DataFrame:
    """The row at index k (from 0) of a total order."""
    return df.orderBy(*order).offset(k).limit(1)


def addresses(scenes: DataFrame) -> DataFrame:
    return scenes.select("sid", xml_address("sid", "product_id", "granule_id").alias("address"))


def detection_key(lon: str, lat: str):
    return coordinate_suffix(lon, lat)
