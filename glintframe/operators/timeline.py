"""Timelines of states per structure: outliers, blocks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import checkpointed
from ..functions.scalars import colour_state, divided, state_colour


def timeline(obs: DataFrame, flare_first: bool = True, drop_outliers: bool = False, by: str = "structure_id", ts: str = "granule_date", tie: str = "system_index") -> DataFrame:
    """`obs` with colour and is_outlier: the colour differs from the one before and the one after.

    A missing neighbour counts as different, so a structure's only row is an outlier.
    """
    w = Window.partitionBy(by).orderBy(ts, tie)
    t = obs.withColumn("colour", state_colour("structure_present", "flare_present", flare_first))
    apart = lambda other: ~F.col("colour").eqNullSafe(other)
    t = t.withColumn("is_outlier", apart(F.lag("colour").over(w)) & apart(F.lead("colour").over(w)))
    return t.where(~F.col("is_outlier")) if drop_outliers else t


def state_blocks(t: DataFrame, drop_zero: bool = True, by: str = "structure_id", ts: str = "granule_date", tie: str = "system_index") -> DataFrame:
    """Runs of one colour: start, end (the last granule in the run), state, duration_s, granules."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    changed = (~F.col("colour").eqNullSafe(F.lag("colour").over(w))).cast("int")
    t = t.withColumn("__changed", changed).withColumn("block", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = t.groupBy(by, "block", "colour").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("granules"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = F.floor((micros("end") - micros("start")) / 1_000_000)
    b = b.withColumn("duration_s", seconds).withColumn("state", colour_state("colour"))
    return b.where(F.col("end") > F.col("start")) if drop_zero else b


def structure_summary(obs: DataFrame, least_present: float = 10.0, least_flaring: float = 10.0, by: str = "structure_id") -> DataFrame:
    """Counts and shares of each structure in one pass, kept where both shares exceed their limit."""
    present, flare = F.col("structure_present") == 1, F.col("flare_present") == 1
    s = obs.groupBy(by).agg(
        F.count("*").alias("n_total"), F.count_if(present).alias("n_present"), F.count_if(flare).alias("n_flare"),
        F.min(F.when(present, F.col("granule_date"))).alias("first_present"), F.max(F.when(present, F.col("granule_date"))).alias("last_present"))
    s = s.withColumn("present_percent", divided(F.col("n_present") * 100, "n_total")).withColumn("flare_percent", divided(F.col("n_flare") * 100, "n_present"))
    return s.where((F.col("present_percent") > least_present) & (F.col("flare_percent") > least_flaring))


def strong_stats(obs: DataFrame, least: float = 0.5, by: str = "structure_id") -> DataFrame:
    """mean, sample deviation (NULL of one) and count of anomalies of `least` or more."""
    return obs.where(F.col("max_tai") >= least).groupBy(by).agg(F.avg("max_tai").alias("tai_mean"), F.stddev_samp("max_tai").alias("tai_std"), F.count("*").alias("tai_n"))


def first_row(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in a total order: arg-max, arg-min, level preference, latest."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with place, from 1 on, in a total order.

    Rows are dealt by ranges of the order, and the places of a range begin after the counts of those before it,
    so no task numbers all rows.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # a row per range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__k", within).join(F.broadcast(base), "__range").withColumn("place", F.col("__base") + F.col("__k")).drop("__range", "__base", "__k")


def wrapped(df: DataFrame, order: str, step: int) -> DataFrame:
    """`df` with the index reached from each row's own by a step that wraps around the end."""
    n = df.count()
    return df.withColumn("target", F.pmod(F.col(order) + step, F.lit(max(n, 1))))


def zonal(pixels: DataFrame, by: list[str], zero_is_missing: bool = False) -> DataFrame:
    """Cloud mean, least water index and largest anomaly of each zone, with the stand-ins for missing ones."""
    from ..functions.scalars import defaulted, ndwi, thermal_anomaly

    z = pixels.groupBy(*by).agg(F.avg("probability").alias("cloud"), F.min(ndwi("b3", "b8")).alias("ndwi"), F.max(thermal_anomaly("b8a", "b11", "b12")).alias("tai"))
    z = z.select(*by, defaulted("cloud", 100.0, zero_is_missing).alias("cloud_fraction"), defaulted("ndwi", 9999.0, zero_is_missing).alias("min_ndwi"), defaulted("tai", -9999.0, zero_is_missing).alias("max_tai"))
    return z.withColumn("structure_present", (F.col("min_ndwi") < 0).cast("int")).withColumn("flare_present", (F.col("max_tai") > 0.15).cast("int"))


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """bin, n, cumulative over equal-width bins between the extremes; empty bins are there, NULLs are not."""
    by = by or []
    v = F.col(value)
    ends = df.where(v.isNotNull()).groupBy(*by).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    k = F.least(F.coalesce(F.floor(divided((v - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))), F.lit(0)), F.lit(bins - 1))
    met = df.where(v.isNotNull())
    met = met.join(ends, by) if by else met.join(F.broadcast(ends))
    counts = met.groupBy(*by, k.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = every.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    run = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative", F.sum("n").over(run))


def pixel_composite(pixels: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, <value>_min, <value>_max, <value>_mean, n: each pixel over all its scenes, NULLs left out; one map-side aggregation."""
    return pixels.groupBy(*keys).agg(F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"), F.avg(value).alias(f"{value}_mean"), F.count(value).alias("n"))


def sampled_keys(df: DataFrame, key: str, fraction: float = 0.001, seed: int = 6) -> DataFrame:
    """max(1, fraction of the) distinct keys, the first by the hash of key and seed: the same ones on every run."""
    keys = df.select(key).distinct()
    return keys.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(max(1, int(keys.count() * fraction)))
