"""Readers, writers, manifest and streams on small files."""

import io
import json
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import scalars as X
from glintframe.sources import raster, readers, sinks
from glintframe.sources.download import fetch
from glintframe.streaming import ingest


def test_sites(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("lon,lat,start,end,system_index\n1.5,2.5,2020-01-01,2020-01-31,a; b;\n3,4,,2020-02-28,\n5,6,2020-03-01,2020-03-01,\n")
    rows = readers.read_sites(spark, str(tmp_path / "sites.csv"), keep=[0, 1], default_start="2019-01-01").orderBy("row_index").collect()
    assert [(r["row_index"], str(r["start"]), str(r["end_exclusive"])) for r in rows] == [(0, "2020-01-01", "2020-02-01"), (1, "2019-01-01", "2020-02-29")]
    assert rows[0]["system_index"] == ["a", "b"]
    assert readers.read_sites(spark, "").first()["row_index"] == -1


def test_sites_without_optional_column(spark, tmp_path):
    (tmp_path / "s.csv").write_text("lon,lat,start,end\n1,2,2020-01-01,2020-01-02\n")
    assert readers.read_sites(spark, str(tmp_path / "s.csv")).first()["system_index"] is None


GRANULE = """<r><Sun_Angles_Grid><Zenith><Values_List><VALUES>1 2</VALUES><VALUES>3 NaN</VALUES></Values_List></Zenith>
<Azimuth><Values_List><VALUES>5 6</VALUES><VALUES>7 8</VALUES></Values_List></Azimuth></Sun_Angles_Grid>
{views}<Geoposition><ULX>500000</ULX><ULY>4100000</ULY></Geoposition><HORIZONTAL_CS_CODE>EPSG:32615</HORIZONTAL_CS_CODE></r>"""
VIEW = "<Viewing_Incidence_Angles_Grids bandId='12'>{}</Viewing_Incidence_Angles_Grids>"


def test_granule_xml(spark, tmp_path):
    values = lambda a, b: f"<Values_List><VALUES>{a}</VALUES><VALUES>{b}</VALUES></Values_List>"
    views = "".join(VIEW.format(f"<Zenith>{values(z, '4 4')}</Zenith><Azimuth>{values('1 1', '1 1')}</Azimuth>") for z in ("2 NaN", "4 6"))
    (tmp_path / "g1.xml").write_text(GRANULE.format(views=views))
    from glintframe.operators.neighbour import detector_mean

    g = readers.granule_angles(spark, str(tmp_path))
    mean = {(r["kind"], r["i"], r["j"]): r["value"] for r in detector_mean(g).collect()}
    assert mean["view_zenith", 0, 0] == 3.0 and mean["view_zenith", 0, 1] == 6.0 and mean["sun_zenith", 1, 0] == 3.0
    assert mean["sun_zenith", 1, 1] is None
    assert list(readers.granule_corner(spark, str(tmp_path)).first())[1:] == [500000.0, 4100000.0, "EPSG:32615"]


def test_raster_roundtrip(spark, tmp_path):
    grid = np.array([[1.5, np.nan], [3.0, -2.0]])
    (tmp_path / "a.tif").write_bytes(raster.encode(grid))
    got = {(r["row"], r["col"]): r["value"] for r in raster.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.5, (0, 1): None, (1, 0): 3.0, (1, 1): -2.0}
    cells = spark.createDataFrame([("s", i, j, float(i + j)) for i in range(3) for j in range(3)], "sid string, i int, j int, sga double")
    back, _ = raster.decode(bytes(raster.grid_files(cells, "sga").first()["content"]))
    assert back.tolist() == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]


def test_listing_and_features(spark, tmp_path):
    sid = "20170705T164319_20170705T165225_T15RXL"
    (tmp_path / sid).mkdir()
    feature = {"type": "Feature", "geometry": None, "properties": {"system_index": sid}}
    (tmp_path / sid / f"{sid}_VEC_-90.968_27.292.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {**feature, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    (tmp_path / sid / "other.geojson").write_text("{}")
    (tmp_path / "top_VEC_1_2.geojson").write_text("{}")
    found = readers.listed_files(spark, str(tmp_path)).collect()
    assert [(r["system_index"], r["datatype"], r["lon"], r["lat"]) for r in found] == [(sid, "VEC", "-90.968", "27.292")] and found[0]["size"] > 0
    rows = readers.read_features(spark, str(tmp_path / sid)).orderBy("geometry").collect()
    assert [r["geometry"] is None for r in rows if r["properties"] and sid in r["properties"]] == [True, False]


def test_observations(spark):
    row = ("20240105T000000_x", 3.0, -0.1, 1, 0.4, 1, "[[1.0, 2.0], [3, 4]]", None, "POINT (5.5 -6)", 1)
    flat = ("bad", 30.0, -0.1, 1, 0.4, 1, "[]", '{"type":"Point","coordinates":[7,8]}', None, 2)
    p = readers.parsed_observations(spark.createDataFrame([row, flat], readers.OBSERVATION_SCHEMA)).orderBy("structure_id").collect()
    assert (tuple(p[0]["flare_point"]), tuple(p[0]["point"]), str(p[0]["granule_date"])) == ((1.0, 2.0), (5.5, -6.0), "2024-01-05 00:00:00")
    assert (p[1]["flare_point"], tuple(p[1]["point"]), p[1]["granule_date"]) == (None, (7.0, 8.0), None)


def test_catalogue(spark):
    names = spark.createDataFrame([("u1", "S2A_MSIL2A_20200101T000000_N1_T15RXL_A", "2020-01-03"), ("u2", "S2A_MSIL1C_20200101T000000_N1_T15RXL_B", "2020-01-01"), ("u3", "S2A_MSIL1C_20200101T000000_N2_T15RXL_C", "2020-01-02")], "uuid string, name string, start string")
    sids = spark.createDataFrame([("20200101T000000_20200101T000000_T15RXL",)], "sid string")
    assert readers.catalogue_pick(names, sids).first()["uuid"] == "u3"
    assert readers.catalogue_pick(names, sids, prefer_l2a=True).first()["uuid"] == "u1"


def test_node_listings(spark):
    node = [{"Name": "a", "Id": "1"}]
    bodies = [json.dumps(b) for b in ({"value": node}, {"result": node}, {"d": {"results": node}})]
    df = spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "uri string, body string")
    assert [r["name"] for r in readers.listed_nodes(df).collect()] == ["a"] * 3


def test_address(spark):
    df = spark.createDataFrame([("20170705T164319_20170705T165225_T15RXL", "P", "G")], "sid string, product_id string, granule_id string")
    assert readers.addresses(df).first()["address"] == "tiles/15/R/XL/P.SAFE/GRANULE/G/MTD_TL.xml"


@pytest.mark.parametrize("overwrite, state, want", [(True, "ready", "replace"), (True, None, "export"), (False, "ready", "skip"), (False, "ingesting", "wait"), (False, None, "export")])
def test_export_decision(spark, overwrite, state, want):
    wanted = spark.createDataFrame([("s", "MBSP")], "sid string, datatype string")
    there = spark.createDataFrame([("s" if state else "t", "MBSP", state or "ready")], "sid string, datatype string, state string")
    assert sinks.export_decision(wanted, there, overwrite).first()["decision"] == want


def test_pixels_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "px")
    rows = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 2.0)], "sid string, `row` int, col int, r double")
    sinks.write_pixels(rows, folder)
    done = spark.createDataFrame([("a", "MBSP", "ready"), ("b", "MBSP", "ready")], "sid string, datatype string, state string")
    assert sinks.to_export(rows, done, "MBSP").isEmpty()
    sinks.write_pixels(rows.where("sid = 'a'").withColumn("r", rows["r"] + 10), folder)
    assert sorted(map(tuple, spark.read.parquet(folder).select("sid", "r").collect())) == [("a", 11.0), ("b", 2.0)]
    assert sinks.drop_scene(spark, folder, "a") and not sinks.drop_scene(spark, folder, "a")


def test_annotations_and_features(spark, tmp_path):
    sinks.annotate(spark, str(tmp_path / "hitl"), "s", "1.000", "2.000", None)
    saved = spark.read.parquet(str(tmp_path / "hitl"))
    sinks.write_features(saved, str(tmp_path / "out"), "geometry", "system_index")
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()["value"]) == {"type": "Feature", "geometry": None, "properties": {"system_index": "s"}}
    detections = saved.select("system_index", "lon", "lat").union(spark.createDataFrame([("t", "1.000", "2.000")]))
    assert sorted(tuple(r) for r in sinks.reviewed(detections, saved, ["system_index", "lon", "lat"]).select("system_index", "reviewed").collect()) == [("s", True), ("t", False)]


def test_monthly_csv_reads_back(spark, tmp_path):
    rows = spark.sql("select 'T1' tile_id, timestamp_ntz'2024-02-03 00:00:00' datetime, 12.5D alpha")
    sinks.write_csv_by_month(rows, str(tmp_path / "csv"), "datetime", "tile_id", "datetime", "alpha")
    back = readers.read_alpha(spark, str(tmp_path / "csv/year=2024/month=2"))
    assert back.first()["alpha"] == 12.5 and (tmp_path / "csv/year=2024/month=2").exists()


def test_updates_add_a_missing_column(spark):
    sites = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_index int, lon double")
    updates = spark.createDataFrame([(1, "x"), (9, "y")], "row_index int, system_index string")
    assert [r["system_index"] for r in sinks.updated_sites(sites, updates).orderBy("row_index").collect()] == [None, "x"]


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def error(code):
    return urllib.error.HTTPError("u", code, "", {}, None)


def test_download_retries_and_refreshes(tmp_path):
    answers, pauses, refreshed = [error(503), error(403), ConnectionError(), Answer(b"data")], [], []

    def open_url(_):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    target = str(tmp_path / "x")
    assert fetch("http://localhost/x", target, refresh=lambda: refreshed.append(1), open_url=open_url, pause=pauses.append)
    assert (tmp_path / "x").read_bytes() == b"data" and pauses == [1.0, 2.0] and refreshed == [1]
    assert not fetch("http://localhost/x", target)
    with pytest.raises(urllib.error.HTTPError):
        answers.append(error(404))
        fetch("http://localhost/y", str(tmp_path / "y"), open_url=open_url)


def test_stream_ingests_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    scenes = spark.sql("select 's' || id sid, timestamp'2024-01-01 00:00:00' sensing_ts, cast(id * 30 as double) cloudy_pixel_pct, 30D sza, 10D vza_b11, 180D saa, 0D vaa_b11 from range(3)")
    for _ in range(2):
        scenes.write.mode("append").parquet(source)
        stream = ingest.usable_scenes(ingest.landed(spark, source, scenes.schema))
        ingest.appended(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_stream_tile_alpha(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 05:00:00' sensing_ts, 'T' tile, cast(id as double) alpha from range(4)").write.parquet(str(tmp_path / "in"))
    stream = ingest.tile_alpha(ingest.landed(spark, str(tmp_path / "in"), "sensing_ts timestamp, tile string, alpha double"))
    q = stream.writeStream.format("memory").queryName("alpha").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("alpha").select("alpha_min", "alpha_max", "n").first()) == (0.0, 3.0, 4)


def test_number_list(spark):
    assert spark.range(1).select(X.numbers(F.lit(" 1 NaN  2.5 "))).first()[0] == [1.0, None, 2.5]


@pytest.mark.parametrize("shape", [(23, 23), (16, 16), (1, 40)])
def test_tiles_keep_every_value_and_the_crs(shape):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=shape).astype("f4").astype(float)
    grid[0, 0] = np.nan
    back, tags = raster.decode(raster.encode(grid, ulx=500000.0, uly=4100000.0, crs="EPSG:32615"))
    np.testing.assert_array_equal(back, grid)
    assert raster.crs_of(tags) == "EPSG:32615" and tags[33922][3:5] == (500000.0, 4100000.0) and tags[322] == (16,)
    assert raster.crs_of(raster.decode(raster.encode(grid, crs="EPSG:4326"))[1]) == "EPSG:4326" and raster.crs_of({}) is None


def strips(grid, kind, predictor, end="<", rows_per_strip=2):
    """A deflate strip TIFF written apart from the encoder."""
    import struct
    import zlib

    grid = np.asarray(grid).astype(np.dtype(kind).newbyteorder(end))
    size = grid.dtype.itemsize
    body = []
    for at in range(0, len(grid), rows_per_strip):
        part = grid[at:at + rows_per_strip]
        if predictor == 2:
            whole = [[int(v) for v in row] for row in part.view(f"{end}u{size}")]
            part = np.array([[(row[k] - (row[k - 1] if k else 0)) % 256 ** size for k in range(len(row))] for row in whole], dtype=f"{end}u{size}")
        elif predictor == 3:
            planes = [[b for plane in range(size) for v in row for b in [np.array(v, dtype=np.dtype(kind).newbyteorder(">")).tobytes()[plane]]] for row in part]
            part = np.array([[(row[k] - (row[k - 1] if k else 0)) % 256 for k in range(len(row))] for row in planes], dtype=np.uint8)
        body.append(zlib.compress(part.tobytes()))
    out = {"<": b"II", ">": b"MM"}[end] + struct.pack(f"{end}HI", 42, 0)
    offsets = []
    for b in body:
        offsets.append(len(out))
        out += b
    lists = len(out)
    out += struct.pack(f"{end}{2 * len(body)}I", *offsets, *map(len, body))
    short = lambda v: struct.unpack(f"{end}I", struct.pack(f"{end}HH", v, 0))[0]
    several = len(body) > 1
    entries = [(256, 4, 1, grid.shape[1]), (257, 4, 1, grid.shape[0]), (258, 3, 1, short(8 * size)), (259, 3, 1, short(8)),
               (273, 4, len(body), lists if several else offsets[0]), (278, 4, 1, rows_per_strip), (279, 4, len(body), lists + 4 * len(body) if several else len(body[0])),
               (317, 3, 1, short(predictor)), (339, 3, 1, short({"u": 1, "i": 2, "f": 3}[grid.dtype.kind]))]
    at = len(out)
    out += struct.pack(f"{end}H", len(entries)) + b"".join(struct.pack(f"{end}HHII", *e) for e in entries) + struct.pack(f"{end}I", 0)
    return out[:4] + struct.pack(f"{end}I", at) + out[8:]


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("kind, predictor", [("u1", 1), ("u1", 2), ("u2", 2), ("i2", 2), ("f4", 1), ("f4", 2), ("f4", 3), ("f8", 3)])
def test_strips_of_any_sample_and_predictor(kind, predictor, end):
    grid = (np.arange(15).reshape(5, 3) * 7 % 40 - (0 if kind[0] == "u" else 20)).astype(kind)
    back, _ = raster.decode(strips(grid, kind, predictor, end))
    np.testing.assert_array_equal(back, grid.astype(float))


def test_placed_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(raster.encode(np.zeros((3, 3)), 500000.0, 4100000.0, crs="EPSG:32615"))
    assert list(raster.read_corners(spark, str(tmp_path)).first())[1:] == [500000.0, 4100000.0, 5000.0, 5000.0, "EPSG:32615"]


def test_missing_artifacts_are_made_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    wanted = spark.createDataFrame([("a", "SGA"), ("b", "SGA"), ("c", "SGA"), ("c", "SGA")], "sid string, datatype string")
    known = spark.createDataFrame([("a", "SGA", "ready"), ("b", "SGA", "ingesting")], "sid string, datatype string, state string")
    make = lambda sids: sids.select("sid", F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit(2.0).alias("v"))
    assert {(r["sid"], r["exported"]) for r in sinks.ensured(wanted, known, make, folder).collect()} == {("a", False), ("b", False), ("c", True)}
    assert [r["sid"] for r in spark.read.parquet(folder).collect()] == ["c"]
    again = known.union(spark.createDataFrame([("c", "SGA", "ready")], known.schema))
    assert not any(r["exported"] for r in sinks.ensured(wanted, again, lambda sids: 1 / 0, folder).collect())
