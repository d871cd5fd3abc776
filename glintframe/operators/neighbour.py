"""Neighbourhood operators on the dense grid (sid, row, col): masks null values, they never drop rows."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divided, logistic_weight


def complete(pixels: DataFrame, by: str = "sid") -> DataFrame:
    """`pixels` on the whole rectangle of each scene; `present` marks the rows that were there."""
    box = pixels.groupBy(by).agg(F.min("row").alias("__r0"), F.max("row").alias("__r1"), F.min("col").alias("__c0"), F.max("col").alias("__c1"))
    cells = box.select(by, F.explode(F.sequence("__r0", "__r1")).alias("row"), "__c0", "__c1").select(by, "row", F.explode(F.sequence("__c0", "__c1")).alias("col"))
    return cells.join(pixels.withColumn("present", F.lit(True)), [by, "row", "col"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def box_variance(pixels: DataFrame, value: str, radius: int, by: str = "sid") -> DataFrame:
    """`pixels` with `variance`: population variance of valid values in the (2r + 1)^2 square.

    Two passes of range frames over count, sum and sum of squares, along rows and then along columns;
    the scene has to be a whole rectangle (see `complete`).
    Values are centred on the scene mean first, so that small variances do not cancel.
    """
    scene = Window.partitionBy(by)
    across = Window.partitionBy(by, "row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy(by, "col").orderBy("row").rangeBetween(-radius, radius)
    p = pixels.withColumn("__x", F.col(value) - F.avg(value).over(scene))
    for name, x in (("__n", F.when(F.col("__x").isNotNull(), 1.0)), ("__s", F.col("__x")), ("__q", F.col("__x") * F.col("__x"))):
        p = p.withColumn(name, F.coalesce(F.sum(x).over(across), F.lit(0.0)))
    for name in ("__n", "__s", "__q"):
        p = p.withColumn(name, F.sum(name).over(down))
    mean = divided("__s", "__n")
    p = p.withColumn("variance", F.when(F.col("__n") > 0, F.greatest(divided("__q", "__n") - mean * mean, F.lit(0.0))))
    return p.drop("__x", "__n", "__s", "__q")


def logistic_speckle(pixels: DataFrame, value: str, radius: int, sigma0: float, k: float, by: str = "sid") -> DataFrame:
    """`pixels` with sigma, weight and `filtered` = value * weight: rough places fade to zero."""
    p = box_variance(pixels, value, radius, by).withColumn("sigma", F.sqrt("variance"))
    return p.withColumn("weight", logistic_weight("sigma", sigma0, k)).withColumn("filtered", F.col(value) * F.col("weight")).drop("variance")


def focal_median_small(pixels: DataFrame, value: str, radius: int, by: str = "sid") -> DataFrame:
    """sid, row, col, focal_median of the square neighbourhood, for small radii: offsets meet in one aggregation."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    moved = (pixels.where(F.col(value).isNotNull()).select(by, "row", "col", value)
             .withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
             .select(by, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col(value).alias("__v")))
    near = moved.groupBy(by, "row", "col").agg(F.percentile("__v", F.lit(0.5)).alias("focal_median"))
    return pixels.select(by, "row", "col").join(near, [by, "row", "col"], "left")


def focal_median_tiled(pixels: DataFrame, value: str, radius: int, tile: int = 128, by: str = "sid") -> DataFrame:
    """The same for large radii: tiles with a halo of `radius` pixels, one dense array for each.

    A pixel goes to every tile whose halo holds it (at most four for radius <= tile / 2), so a task
    holds (tile + 2 radius)^2 values whatever the scene's size.
    """
    cells = lambda c: F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile))
    tiled = (pixels.select(by, F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("__v"))
             .withColumn("tr", F.explode(cells("row"))).withColumn("tc", F.explode(cells("col"))))
    side = tile + 2 * radius

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tr"].iloc[0]) * tile - radius, int(pdf["tc"].iloc[0]) * tile - radius
        grid = np.full((side, side), np.nan)
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        grid[r, c] = pdf["__v"].to_numpy()
        own = (r >= radius) & (r < radius + tile) & (c >= radius) & (c < radius + tile)
        windows = np.lib.stride_tricks.sliding_window_view(grid, (2 * radius + 1, 2 * radius + 1))
        i, j = r[own] - radius, c[own] - radius
        values = np.full(len(i), np.nan)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # neighbourhoods without a value stay NaN
            for at in range(0, len(i), 4096):
                near = windows[i[at:at + 4096], j[at:at + 4096]]
                values[at:at + 4096] = np.nanmedian(near.reshape(len(near), -1), axis=1)
        values = [None if v != v else v for v in values.tolist()]
        return pd.DataFrame({by: pdf[by][own], "row": pdf["row"][own], "col": pdf["col"][own], "focal_median": pd.array(values, dtype="Float64")})

    kind = dict(pixels.dtypes)[by]
    return tiled.groupBy(by, "tr", "tc").applyInPandas(filtered, f"{by} {kind}, row int, col int, focal_median double")


def bilinear(coarse: DataFrame, fine: DataFrame, value: str, step: float, by: str = "sid") -> DataFrame:
    """`fine` (sid, row, col) with `value` of the coarse grid (sid, i, j) interpolated at row / step, col / step.

    The four neighbours meet in an equi-join; weights of missing neighbours are shared by the others.
    """
    at = fine.withColumn("__y", F.col("row") / step).withColumn("__x", F.col("col") / step)
    at = at.withColumn("__i", F.floor("__y")).withColumn("__j", F.floor("__x"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    at = at.withColumn("__c", corner)
    fy, fx = F.col("__y") - F.col("__i"), F.col("__x") - F.col("__j")
    weight = F.when(F.col("__c.a") == 1, fy).otherwise(1 - fy) * F.when(F.col("__c.b") == 1, fx).otherwise(1 - fx)
    at = at.withColumn("__w", weight).where("__w > 0").withColumn("i", (F.col("__i") + F.col("__c.a")).cast("int")).withColumn("j", (F.col("__j") + F.col("__c.b")).cast("int"))
    met = at.join(coarse.select(by, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col(value).alias("__v")), [by, "i", "j"], "left")
    used = F.when(F.col("__v").isNotNull(), F.col("__w"))
    return met.groupBy(by, "row", "col").agg(divided(F.sum(F.col("__v") * F.col("__w")), F.sum(used)).alias(value))


def detector_mean(grids: DataFrame) -> DataFrame:
    """sid, kind, i, j, value: mean over detectors of each cell, NaN left out."""
    return grids.groupBy("sid", "kind", "i", "j").agg(F.avg(F.nullif(F.col("value"), F.lit(float("nan")))).alias("value"))


def dense(pixels: DataFrame, value: str) -> DataFrame:
    """Missing and NaN become 0."""
    return pixels.withColumn(value, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)))


