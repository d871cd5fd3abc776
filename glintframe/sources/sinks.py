"""Writers and the manifest of artifacts: what to export, what to skip, what to write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import checkpointed
from ..functions.scalars import month_name


def ready(state: Column | str = "state") -> Column:
    """An artifact that exists and is complete."""
    return F.coalesce((F.col(state) if isinstance(state, str) else state) == "ready", F.lit(False))


def export_decision(wanted: DataFrame, artifacts: DataFrame, overwrite: bool = False) -> DataFrame:
    """`wanted` (sid, datatype) with the artifact's state and the decision.

    replace: exists and is to be overwritten; export: missing; wait: being ingested; skip: ready.
    """
    met = wanted.join(artifacts.select("sid", "datatype", "state"), ["sid", "datatype"], "left")
    missing = F.col("state").isNull()
    decision = F.when(missing, "export").when(F.lit(overwrite), "replace").when(F.col("state") == "ingesting", "wait").otherwise("skip")
    return met.withColumn("decision", decision)


def to_export(rows: DataFrame, artifacts: DataFrame, datatype: str, overwrite: bool = False) -> DataFrame:
    """Rows of scenes without the artifact (all rows if overwriting): an anti-join against the manifest."""
    if overwrite:
        return rows
    return rows.join(artifacts.where(F.col("datatype") == datatype).select("sid"), "sid", "left_anti")


def write_pixels(rows: DataFrame, folder: str, artifacts: DataFrame | None = None, datatype: str = "MBSP", overwrite: bool = False) -> None:
    """Pixel rows partitioned by scene; scenes already there stay, or are replaced one partition at a time."""
    if artifacts is not None:
        rows = to_export(rows, artifacts, datatype, overwrite)
    rows.repartition("sid").sortWithinPartitions("sid", "row", "col").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sid").parquet(folder)


def ensured(wanted: DataFrame, artifacts: DataFrame, make, folder: str, overwrite: bool = False) -> DataFrame:
    """`wanted` (sid, datatype; one datatype) with `exported`, after the missing artifacts are made and written.

    Those ready or being ingested stay as they are (exported false); `make(sids)` gives the pixel rows (sid, row, col,
    ...) of the others, which `write_pixels` puts into the folder. Decisions are worked out before anything is written.
    """
    decided = checkpointed(export_decision(wanted.distinct(), artifacts, overwrite))
    todo = decided.where(F.col("decision").isin("export", "replace")).select("sid").distinct()
    if not todo.isEmpty():
        write_pixels(make(todo), folder)
    return decided.select("sid", "datatype", F.col("decision").isin("export", "replace").alias("exported"))


def feature_lines(rows: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """value: one GeoJSON feature a row; geometry is JSON text, or NULL for no plume."""
    shape = F.coalesce(F.col(geometry), F.lit("null"))
    return rows.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("value"))


def write_features(rows: DataFrame, folder: str, geometry: str, *properties: str) -> None:
    feature_lines(rows, geometry, *properties).write.mode("overwrite").text(folder)


def write_csv_by_month(rows: DataFrame, folder: str, ts: str, *columns: str) -> None:
    """Selected columns as CSV, one folder for each year and month."""
    t = rows.select(*columns, F.year(ts).alias("year"), F.month(ts).alias("month"))
    t.write.mode("overwrite").partitionBy("year", "month").csv(folder, header=True)


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").csv(folder, header=True)


def composite_name(day: Column | str, part: str) -> Column:
    """{month}{year}_sunglintAlpha_{part}."""
    d = F.col(day) if isinstance(day, str) else day
    return F.concat(month_name(d), F.date_format(d, "yyyy"), F.lit(f"_sunglintAlpha_{part}"))


def updated_sites(sites: DataFrame, updates: DataFrame) -> DataFrame:
    """Sites whose system_index is the update's where there is one; unknown row indexes are ignored."""
    if "system_index" not in sites.columns:
        sites = sites.withColumn("system_index", F.lit(None).cast("string"))
    met = sites.join(updates.select("row_index", F.col("system_index").alias("__new")), "row_index", "left")
    return met.withColumn("system_index", F.coalesce("__new", "system_index")).drop("__new").select(*sites.columns)


def without_scenes(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of scenes that did not fail: what stays after a clean-up."""
    return rows.join(failed.select("sid").distinct(), "sid", "left_anti")


def drop_scene(spark: SparkSession, folder: str, sid: str) -> bool:
    """Delete a scene's partition; whether it was there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/sid={sid}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def annotate(spark: SparkSession, folder: str, system_index: str, lon: str, lat: str, geometry: str | None) -> None:
    """Append a reviewer's decision; no geometry means no plume."""
    row = [(system_index, lon, lat, geometry)]
    spark.createDataFrame(row, "system_index string, lon string, lat string, geometry string").write.mode("append").parquet(folder)


def reviewed(detections: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Detections with `reviewed`: whether a review of the same keys exists."""
    seen = reviews.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return detections.join(seen, keys, "left").withColumn("reviewed", F.col("__seen").isNotNull()).drop("__seen")
