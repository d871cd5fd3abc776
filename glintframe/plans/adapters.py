"""The test tables as pixels, scenes, observations, sites and band vectors.

Each view is one SQL text that Spark and the oracle engine read alike. Scenes are suppliers, a pixel is
a line item at its place in a 24 column grid; NULL bands are masked pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PX = """
SELECT sid, CAST(FLOOR(pid / 24E0) AS INT) AS "row", CAST(pid - 24 * FLOOR(pid / 24E0) AS INT) AS col,
  -90E0 + (pid - 24 * FLOOR(pid / 24E0)) * 2E-4 AS lon, 27E0 + FLOOR(pid / 24E0) * 2E-4 AS lat,
  -90E0 + 12 * 2E-4 AS site_lon, 27E0 + 12 * 2E-4 AS site_lat,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 8E0 END AS b11,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice / 8E0 * (7E-1 + 3E0 * l_discount) END AS b12,
  250E0 + 15E0 * l_quantity AS b2, 300E0 + 20E0 * l_quantity AS b3, 280E0 + 18E0 * l_quantity AS b4,
  1300E0 - 20E0 * l_quantity AS b8, 500E0 + 40E0 * l_quantity AS b8a,
  CASE WHEN l_returnflag = 'R' OR sid % 3 = 1 THEN NULL ELSE 1E0 - 5E0 * l_discount END AS cs_cdf,
  CASE WHEN sid % 3 = 2 THEN NULL ELSE 1000E0 * l_tax END AS probability,
  CAST((l_linenumber % 4) * 1024 AS INT) AS qa60, CAST(l_partkey % 40 AS DOUBLE) AS sga,
  CASE WHEN sid % 11 = 0 THEN NULL ELSE sid % 13 - 4E0 END AS u, CASE WHEN sid % 11 = 0 THEN NULL ELSE sid % 7 - 3E0 END AS v
FROM (
  SELECT *, l_suppkey AS sid, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pid
  FROM lineitem
) t
"""

SCENE = """
SELECT o_orderkey AS sid, o_orderdate AS sensing_ts, o_custkey % 50 AS tile, CAST(o_orderkey % 100 AS DOUBLE) AS cloudy_pixel_pct,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 1E1 + o_totalprice - FLOOR(o_totalprice / 50E0) * 50E0 END AS sza,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice - FLOOR(o_totalprice / 360E0) * 360E0 END AS saa,
  1E0 + o_totalprice - FLOOR(o_totalprice / 11E0) * 11E0 AS vza_b11, 1E0 + o_totalprice - FLOOR(o_totalprice / 12E0) * 12E0 AS vza_b12,
  o_totalprice - FLOOR(o_totalprice / 357E0) * 357E0 AS vaa_b11, o_totalprice - FLOOR(o_totalprice / 353E0) * 353E0 - 20E0 AS vaa_b12
FROM orders
"""

OBS = """
SELECT user_id AS structure_id, event_id AS system_index, ts AS granule_date, value / 2E2 - 1E-1 AS max_tai,
  CAST(event_id % 100 AS DOUBLE) AS cloud_fraction, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS structure_present,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS flare_present, event_type, value,
  (user_id * 37 % 3600) / 1E1 - 180E0 + (event_id % 7) * 1E-4 AS lon, (user_id * 91 % 1400) / 1E1 - 70E0 + (event_id % 5) * 1E-4 AS lat
FROM events
"""

SITE = "SELECT c_custkey AS site_id, (c_custkey * 37 % 3600) / 1E1 - 180E0 AS lon, (c_custkey * 91 % 1400) / 1E1 - 70E0 AS lat FROM customer"

STRUCTURE = "SELECT s_suppkey AS structure_id, (s_suppkey * 37 % 3600) / 1E1 - 179.95E0 AS lon, (s_suppkey * 91 % 1400) / 1E1 - 70.02E0 AS lat FROM supplier"

VIEWS = {"px": (PX, "lineitem"), "scene": (SCENE, "orders"), "obs": (OBS, "events"), "site": (SITE, "customer"), "structure": (STRUCTURE, "supplier")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, source = VIEWS[name]
    return spark.sql(text.replace('"row"', "`row`").replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: table(spark, sf_dir, source)})


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the named views in front."""
    sql, start = sql.strip(), "WITH "
    own = ", ".join(f"{n} AS ({VIEWS[n][0]})" for n in names)
    if sql.startswith("WITH RECURSIVE "):
        start = "WITH RECURSIVE "
    return f"{start}{own}, {sql[len(start):]}" if sql.startswith("WITH ") else f"{start}{own} {sql}"
