"""Queries that work on every row of their tables, against brute force in pandas."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glintframe.operators.timeline import placed
from glintframe.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("choice", ["earliest", "nearest"])
def test_all_wind_records_are_joined(spark, choice):
    e = pd.read_parquet(f"{FOLDER}/events.parquet")
    records, hour = e[e.event_type == "view"], pd.Timedelta(hours=1)
    want = {}
    for image in e[e.event_type == "click"].itertuples():
        met = records[(records.ts >= image.ts - hour) & (records.ts < image.ts + hour)]
        far = met.ts if choice == "earliest" else (met.ts - image.ts).abs()
        want[image.event_id] = (len(met), far.min() if len(met) else None)
    got = {}
    clicks = e.set_index("event_id").ts
    for r in registry.QUERIES[f"asof_wind_{choice}"](spark, FOLDER).collect():
        at = None if r["record_ts"] is None else pd.Timestamp(r["record_ts"])
        got[r["image_id"]] = (r["candidates"], at if at is None or choice == "earliest" else abs(at - clicks[r["image_id"]]))
    assert got == want and sum(n for n, _ in got.values()) > 0


def test_every_id_of_a_tile_is_listed(spark):
    o = pd.read_parquet(f"{FOLDER}/orders.parquet")
    want = o.groupby(o.o_custkey % 50).o_orderkey.agg(lambda k: ",".join(map(str, sorted(set(k))))).to_dict()
    assert {r["tile"]: r["sids"] for r in registry.QUERIES["distinct_sorted_ids"](spark, FOLDER).collect()} == want


def test_every_scene_has_its_place_and_missing_angles_are_last(spark):
    rows = sorted(registry.QUERIES["scenes_by_alpha_missing_last"](spark, FOLDER).collect(), key=lambda r: r["place"])
    o = pd.read_parquet(f"{FOLDER}/orders.parquet")
    assert [r["place"] for r in rows] == list(range(1, len(o) + 1)) and {r["sid"] for r in rows} == set(o.o_orderkey)
    order = [(r["alpha"] is None, r["alpha"] or 0.0, r["sid"]) for r in rows]
    assert order == sorted(order)
    assert sum(r["alpha"] is None for r in rows) == (o.o_orderstatus == "P").sum() > 0


@pytest.mark.parametrize("rows", [0, 1, 700])
def test_places_with_ties_and_missing_values(spark, rows):
    values = [(k, None if k % 3 == 0 else float(k % 5)) for k in range(rows)]
    df = spark.createDataFrame(values, "k int, x double").repartition(3)
    got = {r["k"]: r["place"] for r in placed(df, F.asc_nulls_last("x"), F.asc("k")).collect()}
    order = sorted(values, key=lambda v: (v[1] is None, v[1] or 0.0, v[0]))
    assert got == {k: n for n, (k, _) in enumerate(order, 1)}


def test_scenes_are_found_for_sites_of_the_whole_table(spark):
    sites = sorted(pd.read_parquet(f"{FOLDER}/customer.parquet").c_custkey)
    e = pd.read_parquet(f"{FOLDER}/events.parquet")
    e = e[(e.ts >= "2024-01-05") & (e.ts < "2024-01-08")]
    want = {(sites[0] + k % len(sites), k) for k in e.event_id}
    rows = registry.QUERIES["scenes_of_sites"](spark, FOLDER).collect()
    assert len(rows) == len(want) and {(r["site_id"], r["sid"]) for r in rows} == want


def test_all_observations_of_a_structure_are_members(spark):
    e = pd.read_parquet(f"{FOLDER}/events.parquet")
    want = e.groupby("user_id").event_id.agg(lambda k: ";".join(map(str, sorted(k)))).to_dict()
    assert {r["structure_id"]: r["members"] for r in registry.QUERIES["group_members"](spark, FOLDER).collect()} == want
