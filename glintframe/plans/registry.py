"""All queries of the reference's operators over the test tables, and their SQL."""

from __future__ import annotations

from . import file_queries, pixel_queries, scene_queries, timeline_queries, workflows  # noqa: F401  they register themselves
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
