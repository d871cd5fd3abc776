"""Pixel predicates, scene filters, composites and their statistics. Masks are boolean columns: rows stay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MaskParams
from ..functions.scalars import all_of, c_glint_angle, col, divided, glint_angle, glint_cosine, metre_offsets, ndwi, normalized_difference, thermal_anomaly

P = MaskParams()
ANGLES = ["sza", "saa", "vza_b11", "vaa_b11", "vza_b12", "vaa_b12"]
ON_LINE_M = 1e-6  # what counts as on the line across the wind


# -- scenes ----------------------------------------------------------------------------------------

def scene_cloud_ok(pct="cloudy_pixel_pct", most: float = P.cloud.scene_pct) -> Column:
    return col(pct) < most


def scene_glint_ok(sza="sza", vza="vza_b11", saa="saa", vaa="vaa_b11", low=P.glint.scene_low, high=P.glint.scene_high) -> Column:
    """low < glint angle < high; scenes without a sun angle are kept."""
    angle = glint_angle(sza, vza, saa, vaa)
    return F.when(col(sza).isNull() | col(vza).isNull(), True).otherwise(F.coalesce((angle > low) & (angle < high), F.lit(True)))


def scenes_in_glint(scenes: DataFrame, sza="sza", vza="vza_b11", saa="saa", vaa="vaa_b11", low=P.glint.scene_low, high=P.glint.scene_high, digits: int = 6) -> DataFrame:
    """The scenes that `scene_glint_ok` keeps, with their `angle`, decided to the last bit as the C library computes it.

    The JVM's sines and arc cosines differ from the C library's in last bits. That shows in the few scenes at a limit,
    around 0 and 180 degrees, where the arc cosine is steep, or half-way between two values of `digits` digits: only those
    are computed again.
    """
    # Exploded, not projected: filters would work the functions out again for each use.
    seen = scenes.withColumn("__x", F.explode(F.array(glint_cosine(sza, vza, saa, vaa))))
    seen = seen.withColumn("__angle", F.explode(F.array(F.degrees(F.acos("__x")))))
    x, angle, scaled = F.col("__x"), F.col("__angle"), F.col("__angle") * 10.0**digits
    close = (F.abs(x) > 1 - 1e-5) | (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-4)
    for limit in (low, high):
        close = close | (F.abs(x - math.cos(math.radians(limit))) < 1e-12)
    close = F.coalesce(close & ~F.isnan(x), F.lit(False))
    within = lambda a: (a > low) & (a < high)
    columns = [c for c in scenes.columns if c != "angle"]
    far = seen.where(~close & F.coalesce(within(angle), F.lit(True))).select(*columns, angle.alias("angle"))
    exact = seen.where(close).select(*columns, c_glint_angle(sza, vza, saa, vaa).alias("angle"))
    return far.unionByName(exact.where(within(F.col("angle"))))


def between_days(ts, start, end) -> Column:
    """start <= ts < end."""
    return (col(ts) >= F.lit(start).cast("timestamp_ntz")) & (col(ts) < F.lit(end).cast("timestamp_ntz"))


def inside_box(lon, lat, west, south, east, north) -> Column:
    return col(lon).between(west, east) & col(lat).between(south, north)


def angles_known() -> Column:
    return all_of([F.col(c).isNotNull() for c in ANGLES])


def angles_positive() -> Column:
    return all_of([F.col(c) > 0 for c in ANGLES])


# -- pixels ----------------------------------------------------------------------------------------

def radius(lon, lat, lon0, lat0, metres: float, inside: bool = True) -> Column:
    dx, dy = metre_offsets(lon, lat, lon0, lat0)
    square = dx * dx + dy * dy
    return square <= metres * metres if inside else square > metres * metres


def unsaturated(limit: float = P.saturation, bands=("b11", "b12")) -> Column:
    return all_of([F.col(b) < limit for b in bands])


def cloud_free(cs="cs_cdf", probability="probability", has_cs="has_cs", has_probability="has_probability", p: MaskParams = P) -> Column:
    """By scene: the score where the scene has scores, else the probability, else everything."""
    return (F.when(col(has_cs), col(cs) >= p.cloud.cs_least)
            .when(col(has_probability), col(probability) < p.cloud.probability_below).otherwise(F.lit(True)))


def water(b3="b3", b8="b8", low: float = P.ndwi_low) -> Column:
    return normalized_difference(b3, b8) > low


def glint_local(sga="sga", high: float = P.glint.local_high) -> Column:
    return col(sga) < high


def glint_indexed(sgi="sgi", low: float = P.glint.index_low) -> Column:
    return col(sgi) > low


def calm(speed="wind_speed", limit: float = P.wind_high, invert: bool = False) -> Column:
    """speed < limit (or > limit); all pixels where there is no wind record."""
    s = col(speed)
    return F.when(s.isNull(), True).otherwise(s > limit if invert else s < limit)


def dot_nonpositive(lon, lat, lon0, lat0, direction, invert: bool = False) -> Column:
    """Half-plane dx cos + dy sin <= 0 against the wind direction; all pixels without a direction.

    Pixels within a thousandth of a millimetre of the line lie on it, so that the last bit of a sine does not decide.
    """
    dx, dy = metre_offsets(lon, lat, lon0, lat0)
    t = F.radians(col(direction))
    half = dx * F.cos(t) + dy * F.sin(t) <= ON_LINE_M
    return F.when(col(direction).isNull(), True).otherwise(~half if invert else half)


def data_ok() -> Column:
    return F.col("b11").isNotNull() & F.col("b12").isNotNull()


def qa60_clear(qa="qa60") -> Column:
    """Bits 10 and 11 both zero."""
    return col(qa).bitwiseAND(3072) == 0


def within_percentiles(df: DataFrame, bands: list[str], valid: Column, low: float, high: float, by: str = "sid") -> DataFrame:
    """`df` with `inlier`: every band within its scene's percentiles over valid pixels, and valid."""
    limits = df.where(valid).groupBy(by).agg(*(F.percentile(F.col(b), F.array(F.lit(low), F.lit(high))).alias(f"__{b}") for b in bands))
    joined = df.join(limits, by, "left")
    ok = all_of([F.col(b).between(F.col(f"__{b}")[0], F.col(f"__{b}")[1]) for b in bands] + [valid])
    return joined.withColumn("inlier", F.coalesce(ok, F.lit(False))).drop(*(f"__{b}" for b in bands))


def sea(pixels: DataFrame, lst: DataFrame, keys: list[str]) -> DataFrame:
    """`pixels` with `sea`: no land surface temperature was ever seen there (missing counts as 0)."""
    mean = lst.groupBy(*keys).agg(F.avg("lst").alias("__lst"))
    return pixels.join(mean, keys, "left").withColumn("sea", F.coalesce(F.col("__lst"), F.lit(0.0)) == 0).drop("__lst")


def flare_review(b8a="b8a", b11="b11", b12="b12") -> Column:
    """Anomaly of 0.45 or more, rising towards b12, and b12 of 1500 or more."""
    a8, a11, a12 = col(b8a), col(b11), col(b12)
    return (thermal_anomaly(b8a, b11, b12) >= 0.45) & ((a12 - a11) >= (a11 - a8)) & (a12 >= 1500)


def flare_viewer(b8a="b8a", b11="b11", b12="b12", least: float = 0.15) -> Column:
    return thermal_anomaly(b8a, b11, b12) >= least


def any_band(bands: list[str]) -> Column:
    return F.coalesce(*(F.col(b) for b in bands)).isNotNull()


def masked(value, condition: Column) -> Column:
    """The value where the condition holds, else NULL."""
    return F.when(condition, col(value))


def with_clouds(pixels: DataFrame, scores: DataFrame, probabilities: DataFrame, keys: tuple[str, ...] = ("sid", "row", "col")) -> DataFrame:
    """`pixels` with cs_cdf and probability of the two cloud tables; NULL where a table has no such pixel.

    Scenes that a table lacks keep their pixels. A cloud pixel given twice counts once, with its least score or
    largest probability.
    """
    score = scores.groupBy(*keys).agg(F.min("cs_cdf").alias("cs_cdf"))
    probability = probabilities.groupBy(*keys).agg(F.max("probability").alias("probability"))
    return pixels.join(score, list(keys), "left").join(probability, list(keys), "left")


# -- composites ------------------------------------------------------------------------------------

def scene_cloud_tiers(pixels: DataFrame, by: str = "sid") -> DataFrame:
    """has_cs, has_probability of each scene."""
    return pixels.groupBy(by).agg(F.bool_or(F.col("cs_cdf").isNotNull()).alias("has_cs"), F.bool_or(F.col("probability").isNotNull()).alias("has_probability"))


def _centre(lon0="site_lon", lat0="site_lat"):
    return "lon", "lat", lon0, lat0


def parts_for_c(p: MaskParams = P) -> dict[str, Column]:
    """The named parts of the mask under which the C factor is fitted."""
    upwind = dot_nonpositive(*_centre(), "wind_dir", invert=True)
    return {
        "region": radius(*_centre(), p.radii.local_m) & (upwind | radius(*_centre(), p.radii.plume_m, inside=False)),
        "data_ok": data_ok(), "saturation": unsaturated(p.saturation), "cloud": cloud_free(p=p), "water": water(low=p.ndwi_low),
        "wind": calm(limit=p.wind_high), "sga": glint_local(high=p.glint.local_high), "sgi": glint_indexed(low=p.glint.index_low),
    }


def parts_for_mbsp(p: MaskParams = P) -> dict[str, Column]:
    """The named parts of the mask under which the ratio is kept."""
    return {
        "region": radius(*_centre(), p.radii.export_m), "data_ok": data_ok(), "saturation": unsaturated(p.saturation),
        "cloud": cloud_free(p=p), "water": water(low=p.ndwi_low), "wind": calm(limit=p.wind_high),
    }


def composite(parts: dict[str, Column]) -> Column:
    """All parts together; a masked part counts as not kept."""
    return F.coalesce(all_of(list(parts.values())), F.lit(False))


def kept_fraction(pixels: DataFrame, mask: str, base: str, by: str = "sid") -> DataFrame:
    """kept: pixels on in `mask` by pixels on in `base`, NULL without any."""
    on = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return pixels.groupBy(by).agg(divided(on(mask), on(base)).alias("kept"))


def removal_pct(pixels: DataFrame, base: Column, parts: dict[str, Column], by: str = "sid") -> DataFrame:
    """Of the pixels in `base`, the share in percent that each part removes; all parts in one pass."""
    base = F.coalesce(base, F.lit(False))
    n = F.count_if(base)
    share = lambda f: divided((n - F.count_if(base & F.coalesce(f, F.lit(False)))) * 100, n)
    return pixels.groupBy(by).agg(n.alias("total"), *(share(f).alias(f"{name}_pct") for name, f in parts.items()))


def gated(pixels: DataFrame, fractions: DataFrame, least: float = P.least_kept, by: str = "sid") -> DataFrame:
    """Pixels of scenes that keep enough; scenes without a fraction go."""
    return pixels.join(fractions.where(F.col("kept") >= least).select(by), by, "left_semi")


def water_index(b3="b3", b8="b8") -> Column:
    return ndwi(b3, b8)
