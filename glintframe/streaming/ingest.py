"""Incremental forms of the workflow for landing folders; an extension, nothing here is needed in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.masks import scene_cloud_ok, scene_glint_ok


def landed(spark: SparkSession, folder: str, schema, files: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def usable_scenes(scenes: DataFrame) -> DataFrame:
    return scenes.where(scene_cloud_ok() & scene_glint_ok())


def tile_alpha(scenes: DataFrame, late: str = "30 days") -> DataFrame:
    """Least, largest and mean glint angle of each tile and day, closed once the watermark passes."""
    return (scenes.withWatermark("sensing_ts", late).groupBy(F.window("sensing_ts", "1 day"), "tile")
            .agg(F.min("alpha").alias("alpha_min"), F.max("alpha").alias("alpha_max"), F.avg("alpha").alias("alpha_mean"), F.count("*").alias("n")))


def appended(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """What is new, appended once and only once, until the folder is read up."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
