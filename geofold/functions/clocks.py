"""Vector clocks as ``map<string,bigint>``; a missing peer counts as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def clock_get(clock, peer) -> Column:
    return F.coalesce(F.element_at(col(clock), col(peer)), F.lit(0)).cast("bigint")


def clock_merge(a, b) -> Column:
    return F.map_zip_with(
        col(a), col(b), lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).cast("bigint")
    )


def clock_compare(a, b) -> Column:
    """'before', 'after', 'concurrent' or 'equal'."""
    diff = F.map_values(
        F.map_zip_with(col(a), col(b), lambda k, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))
    )
    less, more = F.exists(diff, lambda d: d < 0), F.exists(diff, lambda d: d > 0)
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")
