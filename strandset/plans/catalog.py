"""All queries over the driver's tables, one or more for each operator, and the same in ANSI SQL."""
from __future__ import annotations

from . import compare_queries, interval_queries, io_queries, phase_queries, pileup_queries, report_queries, stitch_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
