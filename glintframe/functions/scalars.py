"""Scalar operators as Column -> Column functions: band math, angles, wind, text, dates, states, geometry.

All of them stay inside Catalyst expressions. NULL is a masked pixel; division by zero gives NULL.
"""

from __future__ import annotations

import datetime
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0  # sphere of the local metre offsets
MERCATOR_M = 6_378_137.0  # sphere of EPSG:3857


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def divided(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


# -- band math -------------------------------------------------------------------------------------

def mbsp_ratio(b11, b12, c) -> Column:
    """(c * b12 - b11) / b11."""
    return divided(col(c) * col(b12) - col(b11), b11)


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b); NULL where an input is negative."""
    a, b = col(a), col(b)
    return F.when((a >= 0) & (b >= 0), divided(a - b, a + b))


def ndwi(b3, b8) -> Column:
    """(b3 - b8) / (b3 + b8), negative inputs included."""
    return divided(col(b3) - col(b8), col(b3) + col(b8))


def visible(b2, b3, b4) -> Column:
    return (col(b2) + col(b3) + col(b4)) / F.lit(3.0)


def glint_index(b12, b_vis) -> Column:
    """Normalised difference of b12 and the visible mean."""
    return normalized_difference(b12, b_vis)


def glint_index_clamped(b12, b_vis) -> Column:
    """(b12 - vis) / max(b12 + vis, 1e-4), kept within [-1, 1]."""
    x = (col(b12) - col(b_vis)) / F.greatest(col(b12) + col(b_vis), F.lit(1e-4))
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))


def thermal_anomaly(b8a, b11, b12) -> Column:
    """(b12 - b11) / b8a."""
    return divided(col(b12) - col(b11), b8a)


def corrected(b12, c) -> Column:
    """b12 * c; the band itself where there is no factor."""
    return col(b12) * F.coalesce(col(c), F.lit(1.0))


def logistic_weight(sigma, sigma0: float, k: float) -> Column:
    """1 / (1 + exp(k (sigma - sigma0)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(k)) * (col(sigma) - F.lit(float(sigma0)))))


# -- angles and wind -------------------------------------------------------------------------------

def glint_cosine(sza, vza, saa, vaa) -> Column:
    """cos s cos v - sin s sin v cos|da|."""
    s, v = F.radians(col(sza)), F.radians(col(vza))
    d = F.radians(F.abs(col(saa) - col(vaa)))
    return F.cos(s) * F.cos(v) - F.sin(s) * F.sin(v) * F.cos(d)


def glint_angle(sza, vza, saa, vaa) -> Column:
    """Sun-glint angle in degrees: acos(cos s cos v - sin s sin v cos|da|)."""
    return F.degrees(F.acos(glint_cosine(sza, vza, saa, vaa)))


def c_glint_angle(sza, vza, saa, vaa) -> Column:
    """The same angle by the C library's functions, in Python; NaN beyond the domain of acos."""
    @F.udf("double")
    def angle(sza, vza, saa, vaa):
        if None in (sza, vza, saa, vaa):
            return None
        s, v, d = math.radians(sza), math.radians(vza), math.radians(abs(saa - vaa))
        x = math.cos(s) * math.cos(v) - math.sin(s) * math.sin(v) * math.cos(d)
        return math.degrees(math.acos(x)) if abs(x) <= 1 else math.nan
    return angle(col(sza), col(vza), col(saa), col(vaa))


def glint_alpha(sza, saa, vza_b11, vza_b12, vaa_b11, vaa_b12, clamp: bool = True) -> Column:
    """The same angle from the arithmetic means of two bands' view angles, by A = 2 cos cos, B = -2 sin sin."""
    v = F.radians((col(vza_b11) + col(vza_b12)) / 2)
    s = F.radians(col(sza))
    phi = F.radians(col(saa) - (col(vaa_b11) + col(vaa_b12)) / 2)
    x = (2 * F.cos(s) * F.cos(v) + (-2 * F.sin(s) * F.sin(v)) * F.cos(phi)) / 2
    if clamp:
        x = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))
    return F.degrees(F.acos(x))


def wind_speed(u, v) -> Column:
    return F.hypot(col(u), col(v))


def wind_direction(u, v) -> Column:
    """Degrees, 0 = east, counter-clockwise, within [0, 360)."""
    return F.pmod(F.degrees(F.atan2(col(v), col(u))) + F.lit(360.0), F.lit(360.0))


# -- similarity ------------------------------------------------------------------------------------

def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weighted_cosine(x, ref, weights) -> Column:
    """sum w x r / (sqrt sum w x^2 * sqrt sum w r^2) of three arrays."""
    x, ref, weights = col(x), col(ref), col(weights)
    xw = F.zip_with(x, weights, lambda a, w: a * w)
    rw = F.zip_with(ref, weights, lambda a, w: a * w)
    dot = total(F.zip_with(xw, ref, lambda a, b: a * b))
    return divided(dot, F.sqrt(total(F.zip_with(xw, x, lambda a, b: a * b))) * F.sqrt(total(F.zip_with(rw, ref, lambda a, b: a * b))))


def weighted_distance(x, ref, weights) -> Column:
    """sqrt sum w (x - r)^2 of three arrays."""
    square = F.zip_with(col(x), col(ref), lambda a, b: (a - b) * (a - b))
    return F.sqrt(total(F.zip_with(square, col(weights), lambda a, w: a * w)))


# -- scene ids and text ----------------------------------------------------------------------------

SID = r"^(\d{8}T\d{6})_(\d{8}T\d{6})_T(\d{2}[A-Z]{3})$"


def parse_sid(sid, strict: bool = False) -> Column:
    """struct(start, proc, tile, date) of a scene id, NULL (or an error if strict) where it is none."""
    s = col(sid)
    part = lambda k: F.regexp_extract(s, SID, k)
    fields = F.struct(part(1).alias("start"), part(2).alias("proc"), part(3).alias("tile"), F.substring(part(1), 1, 8).alias("date"))
    parsed = F.when(s.rlike(SID), fields)
    return F.when(s.isNotNull() & ~s.rlike(SID), F.raise_error(F.concat(F.lit("not a scene id: "), s))).otherwise(parsed) if strict else parsed


def xml_address(sid, product_id, granule_id) -> Column:
    """tiles/{zone}/{band}/{square}/{product}.SAFE/GRANULE/{granule}/MTD_TL.xml."""
    token = F.element_at(F.split(col(sid), "_"), 3)
    return F.concat_ws("/", F.lit("tiles"), F.substring(token, 2, 2), F.substring(token, 4, 1), F.substring(token, 5, 2),
                       F.concat(col(product_id), F.lit(".SAFE")), F.lit("GRANULE"), col(granule_id), F.lit("MTD_TL.xml"))


def listed(text, separator: str = ";") -> Column:
    """Trimmed, non-empty parts of a separated list."""
    return F.filter(F.transform(F.split(col(text), separator), lambda x: F.trim(x)), lambda x: x != "")


def coordinate_suffix(lon, lat) -> Column:
    return F.format_string("%.3f_%.3f", col(lon), col(lat))


def month_name(day) -> Column:
    return F.lower(F.date_format(col(day), "MMMM"))


def numbers(text) -> Column:
    """Blank-separated numbers as an array; NaN becomes NULL."""
    parts = F.filter(F.split(F.trim(col(text)), r"\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.nullif(x.try_cast("double"), F.lit(float("nan"))))


def first_point(text) -> Column:
    """struct(lon, lat) of the first point of a textual list, flat [x, y] or nested [[x, y], ...]."""
    v = F.try_parse_json(col(text))
    value = lambda nested, flat: F.coalesce(F.try_variant_get(v, nested, "double"), F.try_variant_get(v, flat, "double"))
    lon, lat = value("$[0][0]", "$[0]"), value("$[0][1]", "$[1]")
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def point_of(geojson, wkt) -> Column:
    """struct(lon, lat) of a GeoJSON point, else of a WKT point, else NULL."""
    g = F.from_json(col(geojson), "type string, coordinates array<double>")
    json = F.when((g["type"] == "Point") & (F.size(g["coordinates"]) >= 2), F.struct(g["coordinates"][0].alias("lon"), g["coordinates"][1].alias("lat")))
    number = r"(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    pattern = rf"^\s*POINT\s*\(\s*{number}\s+{number}\s*\)\s*$"
    text = F.struct(*(F.regexp_extract(col(wkt), pattern, k).try_cast("double").alias(n) for k, n in ((1, "lon"), (2, "lat"))))
    return F.coalesce(json, F.when(col(wkt).rlike(pattern), text))


# -- dates -----------------------------------------------------------------------------------------

def as_day(value: str | datetime.date) -> datetime.date:
    """A date from a date, a datetime or ISO text; anything else is a TypeError."""
    if isinstance(value, datetime.datetime):
        return value.date()
    if isinstance(value, datetime.date):
        return value
    if isinstance(value, str):
        return datetime.date.fromisoformat(value[:10])
    raise TypeError(f"not a date: {value!r}")


def day_of(text, pattern: str = "yyyyMMdd") -> Column:
    """A timestamp without zone from text, NULL where it does not parse."""
    return F.try_to_timestamp(col(text), F.lit(pattern)).cast("timestamp_ntz")


def days(duration_s) -> Column:
    return col(duration_s) / F.lit(86_400.0)


# -- states ----------------------------------------------------------------------------------------

def state_colour(structure_present, flare_present, flare_first: bool = True) -> Column:
    """green: flaring, red: no structure, yellow: structure without a flare; which one wins if both hold."""
    flare, absent = col(flare_present) == 1, col(structure_present) == 0
    return (F.when(flare, "green").when(absent, "red") if flare_first else F.when(absent, "red").when(flare, "green")).otherwise("yellow")


def colour_state(colour) -> Column:
    c = col(colour)
    return F.when(c == "green", "flaring on").when(c == "yellow", "flaring off").when(c == "red", "structure absent")


def clipped_magnitude(v, most: float) -> Column:
    """v, or `most` where v lies beyond it on either side (the sign is lost)."""
    return F.when(F.abs(col(v)) > most, F.lit(float(most))).otherwise(col(v))


def derived_flaring(max_tai, distance_m) -> Column:
    """(tai > 0.01 and distance < 40) or tai > 0.5."""
    return ((col(max_tai) > 0.01) & (col(distance_m) < 40)) | (col(max_tai) > 0.5)


def defaulted(x, default, zero_is_missing: bool = False) -> Column:
    """x, or `default` where it is missing; `zero_is_missing` reads 0 as missing too."""
    x = col(x)
    return F.when(x.isNull() | (F.lit(zero_is_missing) & (x == 0)), F.lit(default)).otherwise(x)


# -- geometry --------------------------------------------------------------------------------------

def metre_offsets(lon, lat, lon0, lat0) -> tuple[Column, Column]:
    """East and north metres from a centre, with the cosine of the pixel's own latitude."""
    k = math.pi / 180 * EARTH_M
    dx = (col(lon) - col(lon0)) * F.lit(k) * F.cos(F.radians(col(lat)))
    return dx, (col(lat) - col(lat0)) * F.lit(k)


def buffer_box(lon, lat, metres: float) -> dict[str, Column]:
    """west, south, east, north of the box around a point's buffer."""
    dlat = math.degrees(metres / EARTH_M)
    dlon = F.lit(dlat) / F.cos(F.radians(col(lat)))
    return {"west": col(lon) - dlon, "south": col(lat) - dlat, "east": col(lon) + dlon, "north": col(lat) + dlat}


def boxes_meet(west1, south1, east1, north1, west2, south2, east2, north2) -> Column:
    return (col(west1) <= col(east2)) & (col(east1) >= col(west2)) & (col(south1) <= col(north2)) & (col(north1) >= col(south2))


def pixel_place(row, column, west, north, east, south, rows, columns) -> tuple[Column, Column]:
    """Centre (x, y) of a grid cell in a box, row 0 at the top."""
    dx = (col(east) - col(west)) / col(columns)
    dy = (col(north) - col(south)) / col(rows)
    return col(west) + (col(column) + 0.5) * dx, col(north) - (col(row) + 0.5) * dy


def to_mercator(lon, lat) -> tuple[Column, Column]:
    return F.radians(col(lon)) * MERCATOR_M, F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2)) * MERCATOR_M


def from_mercator(x, y) -> tuple[Column, Column]:
    return F.degrees(col(x) / MERCATOR_M), F.degrees(2 * F.atan(F.exp(col(y) / MERCATOR_M)) - F.lit(math.pi / 2))


def planar_distance(x1, y1, x2, y2) -> Column:
    return F.hypot(col(x1) - col(x2), col(y1) - col(y2))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def absorption(delta, k11: float, k12: float) -> Column:
    """Fractional absorption of a column amount: exp(-k12 d) - exp(-k11 d)."""
    return F.exp(F.lit(-float(k12)) * col(delta)) - F.exp(F.lit(-float(k11)) * col(delta))


def inverted_absorption(ratio, k11: float, k12: float, steps: int = 60) -> Column:
    """The amount in [0, top] whose absorption is `ratio`, by bisection; top is where the curve turns.

    k12 > k11 > 0 gives values from 0 down to the turning point; NULL beyond it.
    """
    top = math.log(k12 / k11) / (k12 - k11)
    r = col(ratio)
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi")),
        lambda s, _: F.struct(
            F.when(absorption((s["lo"] + s["hi"]) / 2, k11, k12) > r, (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"),
            F.when(absorption((s["lo"] + s["hi"]) / 2, k11, k12) > r, s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi")))
    lowest = math.exp(-k12 * top) - math.exp(-k11 * top)
    return F.when((r <= 0) & (r >= lowest), (state["lo"] + state["hi"]) / 2)
