"""Plume extraction: three-threshold hysteresis components, their statistics and outlines, flare centroids."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..checkpoint import checkpointed
from ..functions.scalars import col

BURNT_AT_ONCE = 1_000_000  # cells a frame, or those of one outline
STRIDE = 1_000_000  # a component's label is row * STRIDE + col of its first pixel


def passes(value, threshold: float, negative: bool) -> Column:
    return col(value) <= threshold if negative else col(value) >= threshold


def all_negative(p1: float, p2: float, p3: float) -> bool:
    """Thresholds compare with <= only if all of them are negative."""
    return p1 < 0 and p2 < 0 and p3 < 0


def label_cells(row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The least row * STRIDE + col of each cell's 4-connected component."""
    own = row.astype(np.int64) * STRIDE + column
    order = np.argsort(own, kind="stable")
    cells = own[order]
    parent = np.arange(len(cells))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for step in (1, STRIDE):  # right, below
        at = np.searchsorted(cells, cells + step)
        hit = np.flatnonzero((at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == cells + step))
        for i, j in zip(hit.tolist(), at[hit].tolist()):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = np.empty(len(cells), dtype=np.int64)
    out[order] = [cells[root(i)] for i in range(len(cells))]
    return out


def components(cells: DataFrame, tile: int = 1024, by: str = "sid") -> DataFrame:
    """`cells` (sid, row, col, ...) with `label`, the 4-connected component.

    Tiles are labelled apart, so a task holds one tile whatever the scene's size; labels that touch
    across a tile border are joined by minimum labels and pointer jumping, so that an island over n
    tiles takes about log n rounds.
    """
    tiled = cells.withColumn("__tr", F.floor(F.col("row") / tile)).withColumn("__tc", F.floor(F.col("col") / tile))

    def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(label=label_cells(pdf["row"].to_numpy(), pdf["col"].to_numpy()))

    schema = StructType([*tiled.schema.fields, StructField("label", LongType())])
    local = checkpointed(tiled.groupBy(by, "__tr", "__tc").applyInPandas(labelled, schema))
    last = lambda c: F.pmod(F.col(c), F.lit(tile)) == tile - 1
    if local.where(last("row") | last("col")).isEmpty():  # no island reaches the border of a tile
        return local.select(*cells.columns, "label")
    touch = None
    for dr, dc, axis in ((0, 1, "col"), (1, 0, "row")):
        here = local.where(last(axis)).select(by, (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("label").alias("a"))
        met = here.join(local.select(by, "row", "col", F.col("label").alias("b")), [by, "row", "col"]).select(by, "a", "b")
        touch = met if touch is None else touch.union(met)
    touch = checkpointed(touch.union(touch.select(by, "b", "a")).distinct())
    if not touch.isEmpty():
        best = checkpointed(touch.groupBy(by, "a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        while True:
            near = touch.join(best.select(by, F.col("a").alias("b"), F.col("to").alias("far")), [by, "b"]).groupBy(by, "a").agg(F.min("far").alias("far"))
            jump = best.select(by, F.col("a").alias("mid"), F.col("to").alias("next"))  # a label's own label: every label here is an `a`
            after = best.join(near, [by, "a"]).select(by, "a", F.least("to", "far").alias("mid"), F.col("to").alias("old")).join(jump, [by, "mid"])
            after = checkpointed(after.select(by, "a", F.least("mid", "next").alias("to"), "old"))
            done = after.where("to != old").isEmpty()
            best = after.select(by, "a", "to")
            if done:
                break
        local = local.join(best.withColumnRenamed("a", "label"), [by, "label"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    return local.select(*cells.columns, "label")


def plume_pixels(pixels: DataFrame, value: str, p1: float, p2: float, p3: float, by: str = "sid") -> DataFrame:
    """sid, row, col, label, value: the p2 pixels of p1 islands that hold a p3 pixel."""
    negative = all_negative(p1, p2, p3)
    cells = pixels.where(passes(value, p1, negative)).select(by, F.col("row").cast("long"), F.col("col").cast("long"), F.col(value).alias("value"))
    labelled = components(cells, by=by)
    strong = labelled.where(passes("value", p3, negative)).select(by, "label").distinct()
    return labelled.where(passes("value", p2, negative)).join(strong, [by, "label"], "left_semi")


def plume_stats(plumes: DataFrame, by: str = "sid") -> DataFrame:
    """Of each plume: pixels, mean, median, max (of all-negative ones the weakest pixel), extreme value."""
    v = F.col("value")
    return plumes.groupBy(by, "label").agg(
        F.count("*").alias("n_px"), F.avg(v).alias("mean_conf"), F.median(v).alias("median_conf"), F.max(v).alias("max_conf"),
        F.median(v).alias("machine_confidence"), F.when(F.max(v) < 0, F.min(v)).otherwise(F.max(v)).alias("extreme_conf"))


def rings_of(row: np.ndarray, column: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed boundary rings (x, y corners) of a set of cells, cells on the right of the walk.

    Where two cells touch at a corner only, the walk turns so that each keeps a ring of its own.
    """
    cells = set(zip(row.tolist(), column.tolist()))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in sorted(cells):
        for near, start, end in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
            if near not in cells:
                out.setdefault(start, []).append(end)
    rings = []
    while out:
        start = min(out)
        ring, at, came = [start], start, None
        while True:
            ends = out[at]
            if len(ends) > 1 and came is not None:
                dx, dy = at[0] - came[0], at[1] - came[1]
                ends.sort(key=lambda e: (e[0] - at[0], e[1] - at[1]) != (-dy, dx))  # turn to the right first
            step = ends.pop(0)
            if not ends:
                del out[at]
            came, at = at, step
            if at == start:
                break
            ring.append(at)
        corners = [p for k, p in enumerate(ring) if (ring[k - 1][0] - p[0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (ring[k - 1][1] - p[1]) * (ring[(k + 1) % len(ring)][0] - p[0])]
        rings.append([*corners, corners[0]])
    return rings


def ring_area(ring: list[tuple[int, int]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def _holds(ring: list, x: float, y: float) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def multipolygon(row: np.ndarray, column: np.ndarray) -> list:
    """GeoJSON coordinates in pixel corners: outer rings, each followed by its holes."""
    rings = rings_of(row, column)
    outer = [[r] for r in rings if ring_area(r) > 0]
    for hole in (r for r in rings if ring_area(r) <= 0):
        (x, y), (x2, y2) = hole[0], hole[1]
        inner = ((x + x2) / 2 - np.sign(y2 - y) * 0.5, (y + y2) / 2 + np.sign(x2 - x) * 0.5)  # just beside the hole's first side, on a cell
        home = min((p for p in outer if _holds(p[0], *inner)), key=lambda p: ring_area(p[0]), default=outer[0])
        home.append(hole)
    return [[[list(map(int, p)) for p in ring] for ring in polygon] for polygon in outer]


def plume_outlines(plumes: DataFrame, west: float = 0.0, north: float = 0.0, dx: float = 1.0, dy: float = -1.0, by: str = "sid") -> DataFrame:
    """sid, label, geometry: one GeoJSON MultiPolygon for each plume; corners at west + x dx, north + y dy."""
    kind = dict(plumes.dtypes)[by]

    def outlines(frames):
        for pdf in frames:
            shapes = []
            for row, column in zip(pdf["__r"], pdf["__c"]):
                shape = multipolygon(np.asarray(row), np.asarray(column))
                placed = [[[[west + x * dx, north + y * dy] for x, y in ring] for ring in polygon] for polygon in shape]
                shapes.append(json.dumps({"type": "MultiPolygon", "coordinates": placed}))
            yield pd.DataFrame({by: pdf[by], "label": pdf["label"], "geometry": shapes})

    cells = plumes.groupBy(by, "label").agg(F.collect_list(F.struct("row", "col")).alias("__x"))
    cells = cells.select(by, "label", F.col("__x.row").alias("__r"), F.col("__x.col").alias("__c"))
    return cells.mapInPandas(outlines, f"{by} {kind}, label long, geometry string")


def burnt_cells(polygons: list, west: float, north: float, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
    """row, col of the cells whose centre lies in a MultiPolygon's coordinates, by the even-odd rule along each row."""
    edges = [np.column_stack([ring[:-1], ring[1:]]) for polygon in polygons for ring in (np.asarray(r, dtype=float) for r in polygon)]
    if not edges:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x0, y0, x1, y1 = ((np.concatenate(edges) - [west, north, west, north]) / [dx, dy, dx, dy]).T
    first = np.ceil(np.minimum(y0, y1) - 0.5).astype(np.int64)  # centres r + 0.5 of [low, high)
    n = np.ceil(np.maximum(y0, y1) - 0.5).astype(np.int64) - first
    e = np.repeat(np.arange(len(n)), n)
    r = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    x = x0[e] + (r + 0.5 - y0[e]) * (x1[e] - x0[e]) / (y1[e] - y0[e])
    c = np.ceil(x - 0.5).astype(np.int64)  # the crossing switches every centre from here on
    order = np.lexsort((c, r))
    r, c = r[order], c[order]
    start, length = c[::2], c[1::2] - c[::2]  # crossings of a row come in pairs
    rows = np.repeat(r[::2], length)
    return rows, np.repeat(start, length) + np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)


def burnt(outlines: DataFrame, west: float = 0.0, north: float = 0.0, dx: float = 1.0, dy: float = -1.0, by: str = "sid") -> DataFrame:
    """sid, label, row, col of the cells whose centre lies in each outline (GeoJSON MultiPolygon): `plume_outlines` undone."""
    kind = dict(outlines.dtypes)[by]

    def frame(pdf: pd.DataFrame, found: list) -> pd.DataFrame:
        at = np.repeat([k for k, _, _ in found], [len(r) for _, r, _ in found])
        r, c = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        return pd.DataFrame({by: pdf[by].to_numpy()[at], "label": pdf["label"].to_numpy()[at], "row": r, "col": c})

    def cells(frames):
        for pdf in frames:
            found, n = [], 0
            for k, text in enumerate(pdf["geometry"]):
                r, c = burnt_cells(json.loads(text)["coordinates"], west, north, dx, dy)
                found.append((k, r, c))
                n += len(r)
                if n >= BURNT_AT_ONCE:
                    yield frame(pdf, found)
                    found, n = [], 0
            if n:
                yield frame(pdf, found)

    return outlines.select(by, "label", "geometry").mapInPandas(cells, f"{by} {kind}, label long, row long, col long")


def flare_centroids(pixels: DataFrame, by: str = "sid") -> DataFrame:
    """sid, centroids: array of (lon, lat) of the regions where the anomaly equals its scene's largest."""
    top = pixels.groupBy(by).agg(F.max("tai").alias("__top"))
    hot = pixels.join(top, by).where(F.col("tai") == F.col("__top")).select(by, F.col("row").cast("long"), F.col("col").cast("long"), "lon", "lat")
    regions = components(hot, by=by).groupBy(by, "label").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return regions.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "lon", "lat"))), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"))).alias("centroids"))
