"""Joins by time and place whose work grows with their rows, not with pairs; scene limits to the last bit."""

import datetime
import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glintframe.operators import masks as M
from glintframe.operators import spatial as S
from glintframe.plans import registry
from glintframe.sources import readers

START = datetime.datetime(2024, 3, 1)


def most_rows(df) -> int:
    """The most rows that one node of the plan has given out; the plan must have run without adaptive execution."""
    def walk(p):
        made, below = p.metrics().get("numOutputRows"), p.children()
        return max([made.get().value() if made.isDefined() else 0, *(walk(below.apply(k)) for k in range(below.size()))])
    return walk(df._jdf.queryExecution().executedPlan())


def one_plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


static = pytest.fixture(one_plan)


def wind_makes_no_pairs(spark, choice):
    at = lambda k: START + datetime.timedelta(seconds=k)
    images = spark.createDataFrame([(k, at(5 * k)) for k in range(300)], "image int, ts timestamp_ntz")
    records = spark.createDataFrame([(at(7 * k + 1), float(k)) for k in range(300)], "ts timestamp_ntz, u double")
    met = S.asof_in_window(images, records, "image", ["u"], 1.0, choice)
    rows = met.collect()
    assert len(rows) == 300 and all(r["candidates"] == 300 for r in rows)
    assert most_rows(met) <= 4 * 600 and most_rows(met) > 0


def wind_by_hand(spark, choice):
    """Ties with absent values, both ends of the window, images that share an id, without a time or alone, few and many ranges."""
    at = lambda m: None if m is None else START + datetime.timedelta(minutes=m)
    seen = [(1, 0), (1, 200), (2, 60), (3, None), (None, 30), (4, 5000), (5, 61), (6, 200), (7, 120)]
    air = [(0, 2.0), (0, None), (0, 1.0), (60, None), (60, None), (59, 5.0), (90, 3.0), (120, 4.0), (120, 0.5), (None, 9.0), (140, 7.0), (260, 1.0)]
    images = spark.createDataFrame([(k, at(m)) for k, m in seen], "image int, ts timestamp_ntz")
    records = spark.createDataFrame([(at(m), u) for m, u in air], "ts timestamp_ntz, u double")
    want = {}
    for key in {k for k, _ in seen}:
        met = [(abs(m - t) if choice == "nearest" else 0, m, u is None, u or 0.0) for k, t in seen if k == key and k is not None and t is not None for m, u in air if m is not None and t - 60 <= m < t + 60]
        best = min(met, default=None)
        want[key] = (len(met), best and at(best[1]), None if best is None or best[2] else best[3])
    for ranges in (1, 2, 128):
        rows = S.asof_in_window(images, records, "image", ["u"], 1.0, choice, ranges).collect()
        assert len(rows) == len(seen) and {r["image"]: (r["candidates"], r["record_ts"], r["u"]) for r in rows} == want
    assert {r["candidates"] for r in S.asof_in_window(images, records.where("false"), "image", ["u"], 1.0, choice).collect()} == {0}
    assert S.asof_in_window(images.where("false"), records, "image", ["u"], 1.0, choice).isEmpty()


def test_earliest_wind_makes_no_pairs(static):
    wind_makes_no_pairs(static, "earliest")


def test_earliest_wind_by_hand(spark):
    wind_by_hand(spark, "earliest")


def test_nearest_wind_makes_no_pairs(static):
    wind_makes_no_pairs(static, "nearest")


def test_nearest_wind_by_hand(spark):
    wind_by_hand(spark, "nearest")


def rows_moved(df) -> int:
    """Rows that the exchanges of a plan have written; the plan must have run without adaptive execution."""
    def walk(p):
        made, below = p.metrics().get("shuffleRecordsWritten"), p.children()
        return (made.get().value() if made.isDefined() else 0) + sum(walk(below.apply(k)) for k in range(below.size()))
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("choice", ["nearest", "earliest"])
def test_wind_moves_records_once_and_images_twice(static, choice):
    at = lambda k: START + datetime.timedelta(minutes=k)
    images = static.createDataFrame([(k, at(10 * k)) for k in range(600)], "image int, ts timestamp_ntz")
    records = static.createDataFrame([(at(10 * k + 1), float(k)) for k in range(600)], "ts timestamp_ntz, u double")
    met = S.asof_in_window(images, records, "image", ["u"], 1.0, choice)
    assert all(r["candidates"] == sum(10 * r["image"] - 60 <= 10 * k + 1 < 10 * r["image"] + 60 for k in range(600)) for r in met.collect())
    assert 600 < rows_moved(met) <= 600 + 2 * 600 + 300


@pytest.mark.parametrize("choice", ["nearest", "earliest"])
def test_wind_at_times_of_many_images_and_records(spark, choice):
    """Most rows have one time: its range goes to several tasks, and its records are put together first."""
    rng = random.Random(8)
    at = lambda m: None if m is None else START + datetime.timedelta(minutes=m)
    seen = [(rng.randrange(350), rng.choice([600, 600, 600, 601, rng.randrange(1200), None])) for _ in range(400)] + [(None, 600)] * 3
    air = [(rng.choice([600, 600, 600, 541, rng.randrange(1200), None]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(300)]
    want = {}
    for key in {k for k, _ in seen}:
        met = [(abs(m - t) if choice == "nearest" else 0, m, u is None, u or 0.0) for k, t in seen if k == key and None not in (k, t) for m, u in air if m is not None and t - 60 <= m < t + 60]
        best = min(met, default=None)
        want[key] = (len(met), best and at(best[1]), None if best is None or best[2] else best[3])
    images = spark.createDataFrame([(k, at(m)) for k, m in seen], "image int, ts timestamp_ntz")
    records = spark.createDataFrame([(at(m), u) for m, u in air], "ts timestamp_ntz, u double")
    rows = S.asof_in_window(images, records, "image", ["u"], 1.0, choice).collect()
    assert sorted([(r["image"], r["ts"]) for r in rows], key=str) == sorted([(k, at(m)) for k, m in seen], key=str)
    assert all((r["candidates"], r["record_ts"], r["u"]) == want[r["image"]] for r in rows)


def day(n: int) -> datetime.date:
    return START.date() + datetime.timedelta(days=n)


SITE = "row_index int, lon double, lat double, start date, end_exclusive date, system_index array<string>"
SCENE = "sid string, sensing_ts timestamp_ntz, west double, east double, south double, north double"


def test_scenes_meet_sites_by_place_and_day(static):
    sites = static.createDataFrame([(k, float(k), 0.0, day(0), day(1), None) for k in range(300)], SITE)
    scenes = static.createDataFrame([(f"s{k}", START, float(k), float(k), -1.0, 1.0) for k in range(300)], SCENE)
    found = readers.resolved_sites(sites, scenes)
    assert {(r["row_index"], r["sid"]) for r in found.collect()} == {(k, f"s{k}") for k in range(300)}
    joins = re.findall(r"\w+Join \[([^\]]*)\], \[", found._jdf.queryExecution().executedPlan().toString())
    assert joins and all("day" in keys and "," in keys for keys in joins)


def test_footprints_of_every_size_find_their_sites(spark):
    rng = random.Random(5)
    sizes = [0.0, 1e-4, 2.0**-7, 0.3, 1.0, 2.0, 3.7, 64.0, 360.0, 512.0, 513.0, 1e6, math.inf]
    boxes = [(f"s{k}", START + datetime.timedelta(hours=rng.randrange(-30, 90)), rng.uniform(-190, 190), rng.uniform(-95, 95), rng.choice(sizes), rng.choice(sizes)) for k in range(400)]
    boxes = [(sid, ts, float(round(w)), round(w) + dx, float(round(s)), round(s) + dy) for sid, ts, w, s, dx, dy in boxes]
    boxes += [("backward", START, 5.0, -5.0, 0.0, 1.0), ("absent", START, None, 1.0, 0.0, 1.0), ("same", *boxes[0][1:])]
    places = [(k, float(rng.randrange(-180, 180)), float(rng.randrange(-90, 90)), day(rng.randrange(3)), day(rng.randrange(4)), None) for k in range(150)]
    places += [(150, None, 0.0, day(0), day(3), None), (151, 9.0, 9.0, day(0), day(3), ["kept", "kept"]), (152, 9.0, 9.0, day(0), day(3), [])]
    want = {(151, "kept")}
    for k, lon, lat, start, end, ids in places:
        want |= {(k, sid) for sid, ts, w, e, s, n in boxes if not ids and lon is not None and w is not None and start <= ts.date() < end and w <= lon <= e and s <= lat <= n}
    rows = readers.resolved_sites(spark.createDataFrame(places, SITE), spark.createDataFrame(boxes, SCENE)).collect()
    assert len(rows) == len(want) > 100 and {(r["row_index"], r["sid"]) for r in rows} == want


def test_scenes_at_a_limit_of_the_glint_angle_equal_the_sql(spark, tmp_path):
    """Angles that are 40 but for their last bit, ordinary, or absent."""
    prices = [321440.16, 278541.96, 364336.79, 235637.24, 75462.67, 372772.98, None]
    orders = pd.DataFrame({"o_orderkey": range(len(prices)), "o_custkey": 1, "o_orderstatus": "O", "o_totalprice": prices, "o_orderdate": START})
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    c = duckdb.connect()
    c.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet')")
    want = {(k, None if a is None else round(a, 6)) for k, a in c.sql(registry.ORACLE_SQL["scene_sga_filter"]).fetchall()}
    got = {(r["sid"], r["angle"]) for r in registry.QUERIES["scene_sga_filter"](spark, str(tmp_path)).collect()}
    assert got == want and 0 < len({k for k, _ in got} & {0, 1, 2, 3}) < 4


def test_glint_angles_of_the_far_and_the_close_agree(spark):
    angles = [(30.0, 10.0, 180.0, 0.0), (50.0, 8.0, 90.0, 0.0), (10.0, 10.0, 180.0, 0.0), (30.0, 10.0, 0.0, 0.0), (None, 9.0, 1.0, 1.0), (9.0, None, 1.0, 1.0), (9.0, 9.0, None, 1.0), (math.nan, 9.0, 1.0, 1.0)]
    df = spark.createDataFrame(angles, "sza double, vza_b11 double, saa double, vaa_b11 double")
    rows = M.scenes_in_glint(df.withColumn("k", F.monotonically_increasing_id())).collect()
    got = {(r["sza"], r["vza_b11"], r["saa"]): r["angle"] for r in rows}
    assert len(rows) == len(got) and round(got[30.0, 10.0, 180.0], 9) == 20
    assert {k for k, a in got.items() if a is None} == {(None, 9.0, 1.0), (9.0, None, 1.0), (9.0, 9.0, None)}
    assert not any(k[0] is not None and math.isnan(k[0]) for k in got) and (50.0, 8.0, 90.0) not in got
