"""Hand-checked values, small grids and brute force."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from glintframe.functions import scalars as X
from glintframe.operators import masks as M
from glintframe.operators import neighbour as N
from glintframe.operators import plumes as G
from glintframe.operators import retrieval as R
from glintframe.operators import spatial as S
from glintframe.operators import timeline as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def grid(spark, values, sid=1, name="r"):
    rows = [(sid, i, j, None if v is None else float(v)) for i, line in enumerate(values) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, f"sid int, `row` int, col int, {name} double")


def test_uniform_scene(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0)] * 25, "sid int, b11 double, b12 double")
    out = R.fractional_absorption(p).agg(F.min("c"), F.max("c"), F.min("r"), F.max("r")).first()
    assert list(out) == [0.5, 0.5, 0.0, 0.0]


def test_c_factor_and_ratio(spark):
    p = spark.createDataFrame([(1, 100.0, 50.0), (1, 200.0, 120.0), (1, 300.0, 150.0)], "sid int, b11 double, b12 double")
    rows = R.fractional_absorption(p).orderBy("b11").collect()
    assert rows[0]["c"] == pytest.approx(74000 / 39400)
    assert [r["r"] for r in rows] == pytest.approx([-0.060913706, 0.126903553, -0.060913706])


def test_division_by_zero_is_null(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "sid int, b11 double, b12 double")
    assert R.fractional_absorption(p).first()["r"] is None


def test_two_predictors_against_least_squares(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=50), rng.normal(size=50)
    y = 1.5 * x1 - 0.7 * x2 + rng.normal(scale=0.1, size=50)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x1, x2, y)], "x1 double, x2 double, y double")
    c0, c1 = R.fit_two_without_intercept("y", "x1", "x2")
    assert list(df.agg(c0, c1).first()) == pytest.approx(np.linalg.lstsq(np.column_stack([x1, x2]), y, rcond=None)[0].tolist())


@pytest.mark.parametrize("angles, want", [((30, 10, 180), 20), ((30, 10, 0), 40), ((50, 8, 90), 50.466293789)])
def test_glint_angle_both_forms(spark, angles, want):
    s, v, a = map(float, angles)
    lit = F.lit
    got = one(spark, X.glint_angle(lit(s), lit(v), lit(a), lit(0.0)).alias("a"), X.glint_alpha(lit(s), lit(a), lit(v), lit(v), lit(0.0), lit(0.0)).alias("b"))
    assert list(got) == pytest.approx([want, want])


def test_scene_gate_is_strict_and_keeps_missing(spark):
    df = spark.createDataFrame([(30.0, 10.0, 0.0, 0.0), (None, 10.0, 0.0, 0.0), (30.0, 10.0, 180.0, 0.0)], "sza double, vza_b11 double, saa double, vaa_b11 double")
    assert [r[0] for r in df.select(M.scene_glint_ok()).collect()][1:] == [True, True]


def test_masked_inputs_stay_masked(spark):
    none = F.lit(None).cast("double")
    got = one(spark, X.glint_index_clamped(none, F.lit(1.0)), X.glint_alpha(none, none, F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)), X.normalized_difference(F.lit(-1.0), F.lit(2.0)))
    assert list(got) == [None, None, None]


def test_wind(spark):
    got = one(spark, X.wind_speed(F.lit(3.0), F.lit(-4.0)), X.wind_direction(F.lit(3.0), F.lit(-4.0)))
    assert list(got) == pytest.approx([5, 306.869897646])


def test_wind_asof(spark):
    day = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    images = spark.createDataFrame([(1, day(12)), (2, day(23, 59))], "image int, ts timestamp_ntz")
    records = spark.createDataFrame([(day(8, 59), 1.0), (day(9), 2.0), (day(12), 3.0), (day(15), 4.0)], "ts timestamp_ntz, u double")
    earliest = {r["image"]: r for r in S.asof_in_window(images, records, "image", ["u"]).collect()}
    assert (earliest[1]["u"], earliest[1]["candidates"]) == (2.0, 2)
    assert (earliest[2]["u"], earliest[2]["candidates"]) == (None, 0)
    assert S.asof_in_window(images, records, "image", ["u"], choice="nearest").where("image = 1").first()["u"] == 3.0


def test_cloud_tier(spark):
    rows = [("A", 0.65, 99.0), ("A", 0.64, 1.0), ("A", None, 1.0), ("B", None, 64.0), ("B", None, 65.0), ("C", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, sid string, cs_cdf double, probability double")
    got = df.join(M.scene_cloud_tiers(df), "sid").orderBy("i").select(F.coalesce(M.cloud_free(), F.lit(False))).collect()
    assert [r[0] for r in got] == [True, False, False, True, False, True]


def test_logistic_weight(spark):
    got = one(spark, X.logistic_weight(F.lit(0.02), 0.02, 300), X.logistic_weight(F.lit(0.03), 0.02, 300), X.logistic_weight(F.lit(1e9), 0.02, 300))
    assert list(got) == pytest.approx([0.5, 0.047425873, 0.0])


ISLANDS = [
    [-0.03, -0.05, 0.00, -0.03, -0.03, 0.00],
    [-0.03, -0.09, 0.00, -0.03, -0.05, 0.00],
    [0.00, 0.00, -0.10, 0.00, 0.00, 0.00],
    [-0.05, 0.00, 0.00, 0.00, -0.03, -0.045],
    [-0.03, 0.00, 0.00, 0.00, -0.03, -0.08],
]


@pytest.mark.parametrize("tile", [1024, 2])
def test_hysteresis_components(spark, tile, monkeypatch):
    whole = G.components
    monkeypatch.setattr(G, "components", lambda cells, by="sid": whole(cells, tile, by))
    plumes = G.plume_pixels(grid(spark, ISLANDS), "r", -0.02, -0.04, -0.08)
    got = sorted((r["mean_conf"], r["median_conf"], r["max_conf"], r["n_px"]) for r in G.plume_stats(plumes).collect())
    assert [list(g) for g in got] == [pytest.approx(w) for w in ([-0.10, -0.10, -0.10, 1], [-0.07, -0.07, -0.05, 2], [-0.0625, -0.0625, -0.045, 2])]


def test_tiles_agree_with_one_tile(spark):
    rng = np.random.default_rng(4)
    p = grid(spark, np.where(rng.random((23, 31)) < 0.6, -1.0, 1.0)).where("r < 0")
    a, b = (sorted(map(tuple, G.components(p, tile).select("row", "col", "label").collect())) for tile in (1000, 5))
    assert a == b


def test_mixed_signs_compare_upwards(spark):
    assert G.all_negative(-1, -2, -3) and not G.all_negative(-1, 2, -3)


def area(ring):
    return G.ring_area([tuple(p) for p in ring])


def test_outlines_cover_the_cells(spark):
    ring_shape = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (4, 4), (5, 5)]
    shape = G.multipolygon(*map(np.array, zip(*ring_shape)))
    assert sum(area(r) for polygon in shape for r in polygon) == len(ring_shape)
    assert sorted(len(p) for p in shape) == [1, 1, 2]  # two single cells, and one ring with a hole
    df = grid(spark, [[-1, -1], [None, -1]]).where("r is not null").select("sid", F.col("row").cast("long"), F.col("col").cast("long"), F.lit(7).cast("long").alias("label"), F.col("r").alias("value"))
    geometry = json.loads(G.plume_outlines(df, west=10.0, north=50.0, dx=2.0, dy=-2.0).first()["geometry"])
    assert geometry["type"] == "MultiPolygon" and abs(area(geometry["coordinates"][0][0])) == 12.0


def test_flare_centroids(spark):
    rows = [(1, r, c, float(c), float(r), t) for r, c, t in ((0, 0, 0.9), (0, 1, 0.9), (3, 3, 0.9), (5, 5, 0.2))]
    df = spark.createDataFrame(rows, "sid int, `row` int, col int, lon double, lat double, tai double")
    got = G.flare_centroids(df).first()["centroids"]
    assert [(c["lon"], c["lat"]) for c in got] == [(0.5, 0.0), (3.0, 3.0)]


def window(values, i, j, r):
    part = values[max(0, i - r):i + r + 1, max(0, j - r):j + r + 1]
    return part[~np.isnan(part)]


def test_speckle_and_medians_against_brute_force(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(9, 8))
    values[rng.random((9, 8)) < 0.25] = np.nan
    df = grid(spark, [[None if math.isnan(v) else v for v in line] for line in values])
    variance = {(r["row"], r["col"]): r["variance"] for r in N.box_variance(df, "r", 2).collect()}
    small = {(r["row"], r["col"]): r["focal_median"] for r in N.focal_median_small(df, "r", 2).collect()}
    tiled = {(r["row"], r["col"]): r["focal_median"] for r in N.focal_median_tiled(df, "r", 2, tile=4).collect()}
    for i in range(9):
        for j in range(8):
            near = window(values, i, j, 2)
            assert variance[i, j] == pytest.approx(near.var(), abs=1e-12)
            assert small[i, j] == pytest.approx(np.median(near)) == tiled[i, j]


def test_complete_fills_the_rectangle(spark):
    df = grid(spark, [[1, 2], [3, 4]]).where("not (`row` = 1 and col = 1)")
    out = N.complete(df)
    assert (out.count(), out.where("present").count()) == (4, 3)


def test_bilinear(spark):
    coarse = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 1, 1.0), (1, 1, 0, 2.0), (1, 1, 1, 3.0)], "sid int, i int, j int, v double")
    fine = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "sid int, `row` int, col int")
    assert {(r["row"], r["col"]): r["v"] for r in N.bilinear(coarse, fine, "v", 2.0).collect()} == {(1, 1): 1.5, (2, 0): 2.0}


def observations(spark, states, start=dt.datetime(2024, 1, 1)):
    rows = [(1, f"s{k}", start + dt.timedelta(days=5 * k), present, flare) for k, (present, flare) in enumerate(states)]
    return spark.createDataFrame(rows, "structure_id int, system_index string, granule_date timestamp_ntz, structure_present int, flare_present int")


def test_timeline_and_blocks(spark):
    t = T.timeline(observations(spark, [(1, 1), (1, 0), (1, 1), (1, 1), (0, 0)]))
    rows = t.orderBy("granule_date").collect()
    assert [(r["colour"], r["is_outlier"]) for r in rows] == [("green", True), ("yellow", True), ("green", False), ("green", False), ("red", True)]
    blocks = T.state_blocks(t, drop_zero=False).orderBy("start").collect()
    assert [(b["state"], b["duration_s"], b["granules"]) for b in blocks] == [("flaring on", 0, 1), ("flaring off", 0, 1), ("flaring on", 432000, 2), ("structure absent", 0, 1)]
    assert T.state_blocks(t).count() == 1


def test_single_observation_is_an_outlier(spark):
    assert T.timeline(observations(spark, [(1, 1)])).first()["is_outlier"]


def groups_by_walking(points, reach):
    ids, n = [0] * len(points), 0
    for k, p in enumerate(points):
        if ids[k] == 0:
            n += 1
            for j, q in enumerate(points):
                if math.hypot(p[0] - q[0], p[1] - q[1]) <= reach:
                    ids[j] = n
    return ids


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_group_ids(spark, seed):
    rng = random.Random(seed)
    points = [(x, 0.0) for x in (0.0, 0.15, 0.30, 0.45, 0.05)] if seed is None else [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(40)]
    sites = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "ord int, lon double, lat double")
    got = [r["group_id"] for r in S.group_ids(sites, chunk=3).orderBy("ord").collect()]
    assert got == groups_by_walking(points, 0.2)
    if seed is None:
        assert got == [1, 2, 2, 2, 1]


def test_point_in_ring(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))))
    got = one(spark, *(S.point_in_ring(F.lit(x), F.lit(y), ring) for x, y in ((2.0, 0.5), (2.0, 2.0), (5.0, 1.0))))
    assert list(got) == [True, False, False]


def test_similarity(spark):
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    got = one(spark, X.weighted_cosine(a(0.3, 0.1), a(0.2, 0.2), a(1, 1)), X.weighted_distance(a(0.3, 0.1), a(0.2, 0.2), a(1, 1)))
    assert list(got) == pytest.approx([0.894427191, 0.141421356])


@pytest.mark.parametrize("tai, dist, want", [(0.02, 39, True), (0.02, 40, False), (0.51, 900, True), (0.01, 1, False)])
def test_flare_rule(spark, tai, dist, want):
    assert one(spark, X.derived_flaring(F.lit(tai), F.lit(float(dist))))[0] is want


def test_mercator(spark):
    assert list(one(spark, *X.to_mercator(F.lit(-90.968), F.lit(27.292)))) == pytest.approx([-10126511.438, 3160000.897], abs=1)


def test_sid(spark):
    good = one(spark, X.parse_sid(F.lit("20170705T164319_20170705T165225_T15RXL")))[0]
    assert good == Row(start="20170705T164319", proc="20170705T165225", tile="15RXL", date="20170705")
    assert one(spark, X.parse_sid(F.lit("20170705T164319_20170705T165225_15rxl")))[0] is None
    with pytest.raises(Exception, match="not a scene id"):
        one(spark, X.parse_sid(F.lit("x"), strict=True))


def test_absorption_inverts(spark):
    got = one(spark, X.inverted_absorption(X.absorption(F.lit(0.65), 0.5, 1.0), 0.5, 1.0), X.inverted_absorption(F.lit(0.1), 0.5, 1.0))
    assert got[0] == pytest.approx(0.65, abs=1e-3) and got[1] is None


def test_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,), (None,)], "x double")
    assert [(r["n"], r["cumulative"]) for r in T.histogram(df, "x", 5).orderBy("bin").collect()] == [(2, 2), (0, 2), (0, 2), (0, 2), (1, 3)]


def test_zero_can_read_as_missing(spark):
    assert list(one(spark, X.defaulted(F.lit(0.0), 100.0), X.defaulted(F.lit(0.0), 100.0, True))) == [0.0, 100.0]


def test_days_of_any_kind():
    day = dt.date(2024, 5, 6)
    assert [X.as_day(v) for v in (day, dt.datetime(2024, 5, 6, 7), "2024-05-06", "2024-05-06T07:00")] == [day] * 4
    with pytest.raises(TypeError):
        X.as_day(20240506)


def test_boxes_and_pixel_places(spark):
    box = X.buffer_box(F.lit(10.0), F.lit(60.0), 1000.0)
    got = one(spark, (box["north"] - box["south"]).alias("h"), (box["east"] - box["west"]).alias("w"))
    assert got["w"] == pytest.approx(2 * got["h"])
    x, y = X.pixel_place(F.lit(0), F.lit(1), F.lit(0.0), F.lit(4.0), F.lit(8.0), F.lit(0.0), F.lit(4), F.lit(4))
    assert list(one(spark, x, y)) == [3.0, 3.5]
    lits = lambda *v: [F.lit(float(a)) for a in v]
    assert list(one(spark, X.boxes_meet(*lits(0, 0, 2, 2, 1, 1, 3, 3)).alias("a"), X.boxes_meet(*lits(0, 0, 1, 1, 2, 2, 3, 3)).alias("b"))) == [True, False]


def test_wrapped_index(spark):
    df = spark.range(3)
    assert [r["target"] for r in T.wrapped(df, "id", 1).orderBy("id").collect()] == [1, 2, 0]
    assert [r["target"] for r in T.wrapped(df, "id", -1).orderBy("id").collect()] == [2, 0, 1]


def scene_pixels(spark, plume=True):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(30):
        for j in range(30):
            b12 = 100.0 + rng.normal(scale=0.2)
            b11 = 200.0 * (1.0 + (0.12 if plume and 13 <= i < 16 and 14 <= j < 17 else 0.0))
            rows.append(("s", i, j, -90.0 + (j - 15) * 2e-4, 27.0 - (i - 15) * 2e-4, -90.0, 27.0, 50.0, 60.0, 50.0, 20.0, 20.0, b11, b12, 1.0, None, 10.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "sid string, `row` int, col int, lon double, lat double, site_lon double, site_lat double, b2 double, b3 double, b4 double, b8 double, b8a double, b11 double, b12 double, cs_cdf double, probability double, sga double, u double, v double")


@pytest.mark.parametrize("mode", ["none", "median"])
def test_workflow_finds_the_plume(spark, mode):
    from glintframe.config import Speckle
    from glintframe.plans.workflows import plume_workflow

    out = plume_workflow(scene_pixels(spark), speckle_mode=mode, speckle=Speckle(radius_px=1))
    assert out.status.first()["status"] == "ok"
    cells = {(r["row"], r["col"]) for r in out.pixels.collect()}
    assert (14, 15) in cells and all(12 <= i < 17 and 13 <= j < 18 for i, j in cells)
    assert out.plumes.count() == 1 and plume_workflow(scene_pixels(spark, False)).plumes.isEmpty()


def test_workflow_gates_cloudy_scenes(spark):
    from glintframe.plans.workflows import plume_workflow

    out = plume_workflow(scene_pixels(spark).withColumn("cs_cdf", F.lit(0.1)))
    assert out.status.first()["status"] == "c mask mostly empty" and out.ratio.isEmpty()


def test_complex_retrieval_fits_reflectances_within_reach(spark):
    rng = np.random.default_rng(3)
    n = 60
    b = {k: rng.uniform(500, 3000, n) for k in ("b2", "b3", "b4", "b11", "b12")}
    lat = np.where(np.arange(n) < 40, 27.0, 28.0)  # the last twenty lie 111 km off
    rows = [(1, *(float(b[k][i]) for k in b), -90.0, float(lat[i]), -90.0, 27.0, 10.0 if i % 5 else 50.0) for i in range(n)]
    df = spark.createDataFrame(rows, "sid int, b2 double, b3 double, b4 double, b11 double, b12 double, lon double, lat double, site_lon double, site_lat double, sga double")
    got = R.complex_retrieval(df, 0.0, 30.0).orderBy("b11").collect()
    b11, b12, vis = b["b11"] / 1e4, b["b12"] / 1e4, (b["b2"] + b["b3"] + b["b4"]) / 3e4
    s, near = np.clip((b12 - vis) / np.maximum(b12 + vis, 1e-4), -1, 1), np.arange(n) < 40
    a = np.linalg.lstsq(np.column_stack([np.ones(40), s[near]]), b11[near], rcond=None)[0]
    fit = a[0] + a[1] * s
    f11, f12 = b11 - fit, b12 - fit * (b12 / (b11 + 1e-6))
    c = np.linalg.lstsq(np.column_stack([f12, f12 * s])[near], f11[near], rcond=None)[0]
    r = ((c[0] + c[1] * s) * f12 - f11) / (f11 + 1e-6)
    order = np.argsort(b["b11"])
    want = [None if i % 5 == 0 else pytest.approx(r[i], rel=1e-6) for i in order]
    assert [g["r"] for g in got] == want and "__near" not in got[0]


def test_burnt_outlines_are_the_cells(spark):
    rng = np.random.default_rng(5)
    cells = [(s, int(i), int(j), -1.0) for s in range(4) for i, j in np.argwhere(rng.random((9, 9)) < 0.6)]
    labelled = G.components(spark.createDataFrame(cells, "sid int, `row` long, col long, value double"))
    want = {(r["sid"], r["label"], r["row"], r["col"]) for r in labelled.collect()}
    placed = dict(west=100.0, north=50.0, dx=0.5, dy=-0.5)
    got = [(r["sid"], r["label"], r["row"], r["col"]) for r in G.burnt(G.plume_outlines(labelled, **placed), **placed).collect()]
    assert len(got) == len(want) and set(got) == want
    assert G.burnt_cells([], 0, 0, 1, -1)[0].size == 0


def test_long_islands_over_many_tiles(spark):
    cells = [(1, 0, j) for j in range(64)] + [(1, 5, j) for j in range(64) if j != 30]
    got = G.components(spark.createDataFrame(cells, "sid int, `row` long, col long"), tile=2).collect()
    assert {r["label"] for r in got if r["row"] == 0} == {0}
    assert {(r["col"] > 30, r["label"]) for r in got if r["row"] == 5} == {(False, 5 * G.STRIDE), (True, 5 * G.STRIDE + 31)}


def test_cloud_tables(spark):
    p = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 0, 0)], "sid int, `row` int, col int")
    s = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 0, 0.7)], "sid int, `row` int, col int, cs_cdf double")
    b = spark.createDataFrame([(2, 0, 0, 5.0), (9, 0, 0, 5.0)], "sid int, `row` int, col int, probability double")
    assert sorted(tuple(r) for r in M.with_clouds(p, s, b).select("sid", "col", "cs_cdf", "probability").na.fill(-1.0).collect()) == [(1, 0, 0.7, -1.0), (1, 1, -1.0, -1.0), (2, 0, -1.0, 5.0)]


def test_polygons_meet(spark):
    ring = lambda points: [Row(x=float(x), y=float(y)) for x, y in points]
    square = lambda x, y, h: ring([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)])
    schema = "k int, ring array<struct<x: double, y: double>>"
    left = spark.createDataFrame([(1, square(0, 0, 1)), (2, square(10, 10, 5)), (3, None), (4, [])], schema)
    # inside, touching a corner, crossing without a corner inside, apart, around, missing
    right = spark.createDataFrame([(1, square(0, 0, 0.2)), (2, square(2, 2, 1)), (3, ring([(-3, -0.1), (3, -0.1), (3, 0.1), (-3, 0.1)])), (4, square(3, 0, 1)), (5, square(10, 10, 9)), (6, None)], schema)
    for cell in (0.7, 4.0, 100.0):
        assert sorted((r["k"], r["o_k"]) for r in S.ring_join(left, right, cell).collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 5)]
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.5, 0.0), (3, None, 0.0)], "p int, lon double, lat double")
    assert sorted((r["p"], r["o_k"]) for r in S.points_in_rings(points, right, 0.7).collect()) == [(1, 1), (1, 3), (2, 3)]


def test_sampled_keys_repeat(spark):
    df = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    first, again = ({r["k"] for r in T.sampled_keys(x, "k").collect()} for x in (df, df.repartition(7)))
    assert first == again and len(first) == 2 and T.sampled_keys(df.where("k < 3"), "k").count() == 1
