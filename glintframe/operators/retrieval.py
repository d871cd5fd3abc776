"""Methane retrieval: grouped regressions, the band ratio and the two-fit variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col, divided, glint_index_clamped, mbsp_ratio, metre_offsets, visible

UNIT = 10_000.0  # digital numbers of a reflectance of 1
FIT_REACH_M = 50_000.0


def c_factor(mask: Column | None = None, b11="b11", b12="b12") -> Column:
    """sum b11 b12 / sum b12^2 over the pixels where `mask` holds: the slope without an intercept."""
    use = col(b11).isNotNull() & col(b12).isNotNull()
    if mask is not None:
        use = use & F.coalesce(mask, F.lit(False))
    return divided(F.sum(F.when(use, col(b11) * col(b12))), F.sum(F.when(use, col(b12) * col(b12))))


def retrieval(pixels: DataFrame, mask_c: Column, mask_mbsp: Column, by: str = "sid") -> DataFrame:
    """`pixels` with c (fitted under mask_c) and r (NULL outside mask_mbsp); no row is dropped.

    The factor is a window aggregate over the scene, so pixels are dealt by scene once and later steps
    by scene find them there.
    """
    w = Window.partitionBy(by)
    out = pixels.withColumn("c", _over(mask_c, w))
    return out.withColumn("r", F.when(F.coalesce(mask_mbsp, F.lit(False)), mbsp_ratio("b11", "b12", "c")))


def _over(mask: Column, w) -> Column:
    use = F.coalesce(mask, F.lit(False)) & F.col("b11").isNotNull() & F.col("b12").isNotNull()
    return divided(F.sum(F.when(use, F.col("b11") * F.col("b12"))).over(w), F.sum(F.when(use, F.col("b12") * F.col("b12"))).over(w))


def scene_factors(pixels: DataFrame, mask: Column | None = None, by: str = "sid") -> DataFrame:
    """sid, c: one aggregation with map-side sums."""
    return pixels.groupBy(by).agg(c_factor(mask).alias("c"))


def fit_with_intercept(y, x) -> tuple[Column, Column]:
    """intercept, slope of y on [1, x]; NULL where x does not vary."""
    return F.regr_intercept(col(y), col(x)), F.regr_slope(col(y), col(x))


def fit_two_without_intercept(y, x1, x2) -> tuple[Column, Column]:
    """Coefficients of y on [x1, x2] from the normal equations; NULL where they are singular."""
    y, x1, x2 = col(y), col(x1), col(x2)
    ok = y.isNotNull() & x1.isNotNull() & x2.isNotNull()
    s = lambda a, b: F.sum(F.when(ok, a * b))
    s11, s12, s22, t1, t2 = s(x1, x1), s(x1, x2), s(x2, x2), s(x1, y), s(x2, y)
    d = s11 * s22 - s12 * s12
    return divided(t1 * s22 - t2 * s12, d), divided(s11 * t2 - s12 * t1, d)


def complex_retrieval(pixels: DataFrame, low: float, high: float, by: str = "sid", reach_m: float = FIT_REACH_M, unit: float = UNIT) -> DataFrame:
    """The two-fit ratio: flatten both bands along the glint index, refit, ratio, glint angle window.

    Bands count in reflectance (digital number / unit), which the small constants are meant for. Both
    fits take the pixels at most reach_m from the site; every pixel gets a ratio. Adds sgi_c, a0, a1,
    b11f, b12f, c0, c1, r; r is NULL outside low < sga < high.
    """
    b2, b3, b4, b11, b12 = (F.col(b) / unit for b in ("b2", "b3", "b4", "b11", "b12"))
    dx, dy = metre_offsets("lon", "lat", "site_lon", "site_lat")
    p = pixels.withColumn("sgi_c", glint_index_clamped(b12, visible(b2, b3, b4))).withColumn("__near", dx * dx + dy * dy <= reach_m * reach_m)
    near = lambda x: F.when(F.col("__near"), x)
    a0, a1 = fit_with_intercept(near(b11), F.col("sgi_c"))
    p = p.join(p.groupBy(by).agg(a0.alias("a0"), a1.alias("a1")), by)
    fit = F.col("a0") + F.col("a1") * F.col("sgi_c")
    p = p.withColumn("b11f", b11 - fit).withColumn("b12f", b12 - fit * divided(b12, b11 + 1e-6))
    c0, c1 = fit_two_without_intercept(near(F.col("b11f")), F.col("b12f"), F.col("b12f") * F.col("sgi_c"))
    p = p.join(p.groupBy(by).agg(c0.alias("c0"), c1.alias("c1")), by).drop("__near")
    c = F.col("c0") + F.col("c1") * F.col("sgi_c")
    r = divided(c * F.col("b12f") - F.col("b11f"), F.col("b11f") + 1e-6)
    return p.withColumn("r", F.when((F.col("sga") > low) & (F.col("sga") < high), r))


def fractional_absorption(pixels: DataFrame, by: str = "sid") -> DataFrame:
    """c and r of whole scenes without masks."""
    return retrieval(pixels, F.lit(True), F.lit(True), by)


def two_date_difference(target: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """r of a target scene less r of a reference scene of the same ground."""
    return target.join(reference.withColumnRenamed("r", "r_reference"), keys).withColumn("mbmp", F.col("r") - F.col("r_reference"))
