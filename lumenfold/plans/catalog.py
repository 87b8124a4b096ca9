"""All queries of the library over the standard tables, with their SQL."""

from __future__ import annotations

from . import angles, arrays, checks, files, places, rankings, shade, spatial, stores, strings, tiles, verdicts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "win01_sunny_windows"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
