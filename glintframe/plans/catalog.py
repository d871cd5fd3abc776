"""Where queries register: a name, a plan over a data folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def counted(sql: str) -> str:
    """count_if(x), a HUGEINT there, as the count of a case, a BIGINT as here."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if('):end - 1]} THEN 1 END){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None, *views: str):
    """Register a plan as `name`; sql may use the named views."""
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLE_SQL[name] = counted(with_views(sql, *views) if views else sql)
        return plan
    return register


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


#: SQL pieces that several oracles share.
ND = "CASE WHEN {a} >= 0 AND {b} >= 0 AND {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END"
WATER = f"({ND.format(a='b3', b='b8')}) > 0"
VIS = "((b2 + b3 + b4) / 3E0)"
SGI = ND.format(a="b12", b=VIS)
SGIC = f"CASE WHEN b12 IS NOT NULL THEN greatest(least((b12 - {VIS}) / greatest(b12 + {VIS}, 1E-4), 1E0), -1E0) END"
TAI = "CASE WHEN b8a <> 0 THEN (b12 - b11) / b8a END"
DX = "((lon - site_lon) * 111194.92664455873E0 * cos(radians(lat)))"
DY = "((lat - site_lat) * 111194.92664455873E0)"
ANGLE = "degrees(acos(cos(radians(sza)) * cos(radians(vza_b11)) - sin(radians(sza)) * sin(radians(vza_b11)) * cos(radians(abs(saa - vaa_b11)))))"
ALPHA = ("CASE WHEN sza IS NOT NULL AND saa IS NOT NULL THEN degrees(acos(greatest(least((2 * cos(radians(sza)) * cos(radians((vza_b11 + vza_b12) / 2)) "
         "- 2 * sin(radians(sza)) * sin(radians((vza_b11 + vza_b12) / 2)) * cos(radians(saa - (vaa_b11 + vaa_b12) / 2))) / 2, 1E0), -1E0))) END")
COLOUR = "CASE WHEN flare_present = 1 THEN 'green' WHEN structure_present = 0 THEN 'red' ELSE 'yellow' END"
