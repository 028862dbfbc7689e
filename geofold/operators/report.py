"""Control-site windows, metrics and lookups for the quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import M_PER_DEG, bbox_for_site, big
from .aggregates import changed_fraction, coverage_mode, scalar_stats
from .skew import salted_join


def control_windows(sites: DataFrame) -> DataFrame:
    """Grid of ``image_size`` points on each side of every site's window; row 0 is north."""
    b = bbox_for_site("lat", "lon", "window_m")
    n = F.greatest(F.col("image_size") - 1, F.lit(1))
    span = F.sequence(F.lit(0).cast("bigint"), F.col("image_size") - 1)
    g = sites.withColumn("_b", b).withColumn("r", F.explode(span)).withColumn("c", F.explode(span))
    lat = F.col("_b.lat_max") - (F.col("_b.lat_max") - F.col("_b.lat_min")) * F.col("r") / n
    lon = F.col("_b.lon_min") + (F.col("_b.lon_max") - F.col("_b.lon_min")) * F.col("c") / n
    return g.select("site_id", "category", "r", "c", lat.alias("lat"), lon.alias("lon"))


def control_metrics(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """Statistics, centre values, changes and coverage per site.

    ``windows``: site_id, r, c, source_m, generated_m, engineered (flag), context (flag).
    """
    src = scalar_stats(windows, ["site_id"], "source_m")
    gen = scalar_stats(windows, ["site_id"], "generated_m")
    moved = changed_fraction(windows, "source_m", "generated_m", ["site_id"])
    cover = windows.groupBy("site_id").agg(F.count_if("engineered").alias("engineered_cells"), F.count_if("context").alias("context_cells"))
    mid = F.floor(F.col("image_size") / 2)
    centre = windows.join(sites.select("site_id", "image_size", "reference_m", "reference_status"), "site_id").where((F.col("r") == mid) & (F.col("c") == mid))
    delta = F.when(rules.reference_usable("reference_status"), F.col("generated_m") - F.col("reference_m"))
    centre = centre.select("site_id", F.col("source_m").alias("centre_source_m"), F.col("generated_m").alias("centre_generated_m"), delta.alias("reference_delta_m"))
    out = sites.select("site_id", "category").join(src, "site_id").join(gen, "site_id").join(moved, "site_id").join(cover, "site_id").join(centre, "site_id", "left")
    span = (F.col("generated_m_max") - F.col("generated_m_min")).alias("span_m")
    return out.select("*", span, coverage_mode("engineered_cells", "context_cells").alias("coverage"))


def category_aggregate(metrics: DataFrame) -> DataFrame:
    """Per category: sites, mean span, mean 95th percentile, and sites by coverage."""
    return metrics.groupBy("category").agg(
        F.count(F.lit(1)).alias("sites"), F.avg("span_m").alias("mean_span_m"), F.avg("generated_m_p95").alias("mean_p95_m"),
        F.count_if(F.col("coverage") == "engineered_ground_active").alias("engineered_sites"),
        F.count_if(F.col("coverage") == "osm_context_only").alias("context_sites"),
    )


def category_warnings(aggregate: DataFrame, expected: DataFrame) -> DataFrame:
    """Categories with fewer sites than the atlas expects."""
    j = expected.join(aggregate.select("category", "sites"), "category", "left").withColumn("sites", F.coalesce("sites", F.lit(0)))
    return j.where(F.col("sites") < F.col("expected_min"))


def _flat_m(lat1, lon1, lat2, lon2):
    dy, dx = (lat1 - lat2) * M_PER_DEG, (lon1 - lon2) * M_PER_DEG * F.cos(F.radians(lat2))
    return F.sqrt(dy * dy + dx * dx)


def anchor_nearest(targets: DataFrame, columns: DataFrame, limit_m: float, prefer_water: bool = False) -> DataFrame:
    """Nearest column of each target ``(target, lat, lon)`` within ``limit_m``.

    With ``prefer_water`` columns flagged ``is_water`` come first.  Equal distances to 1e-6 go by x, z, then y.
    """
    step = limit_m / M_PER_DEG * 2.0
    span = F.sequence(F.lit(-1), F.lit(1))

    def cell(v):
        return big(F.floor(F.col(v) / step))

    # A cell is two limits wide at the equator, and still over one at 60 degrees of latitude.
    probe = targets.select("target", F.col("lat").alias("_la"), F.col("lon").alias("_lo"), cell("lat").alias("gy"), cell("lon").alias("gx"))
    probe = probe.withColumn("_d", F.explode(span)).withColumn("gy", F.col("gy") + F.col("_d"))
    probe = probe.withColumn("_d", F.explode(span)).withColumn("gx", F.col("gx") + F.col("_d")).drop("_d")
    placed = columns.withColumn("gy", cell("lat")).withColumn("gx", cell("lon"))
    near = salted_join(placed, probe, ["gy", "gx"], ["vx", "vz"]).withColumn("dist_m", _flat_m(F.col("lat"), F.col("lon"), F.col("_la"), F.col("_lo")))
    near = near.where(F.col("dist_m") <= limit_m)
    rank = [F.round("dist_m", 6), F.col("vx"), F.col("vz"), F.col("y")]
    if prefer_water:
        rank = [F.when(F.col("is_water"), 0).otherwise(1), *rank]
    best = near.groupBy("target").agg(F.min_by(F.struct("vx", "vz", "y", "dist_m"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(rank)])).alias("_b"))
    return best.select("target", "_b.*")


def surface_sampling(sites: DataFrame, columns: DataFrame, n: int, reach: int = 16) -> DataFrame:
    """Cell-centred n x n samples of each site's window, snapped to the best baked column nearby.

    ``sites``: site_id, vx0, vz0, size (window in voxels).  ``columns``: vx, vz, surface_y.  Candidates are the columns up
    to ``reach`` away on both axes; the nearest wins, then the lower x and z.
    """
    span = F.sequence(F.lit(0), F.lit(n - 1))
    s = sites.withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    s = s.withColumn("_x", F.col("vx0") + (F.col("i") + 0.5) * F.col("size") / n).withColumn("_z", F.col("vz0") + (F.col("j") + 0.5) * F.col("size") / n)
    s = s.select("site_id", "i", "j", "_x", "_z")
    # Candidates meet samples in cells of the reach's size: the sample's own cell and the eight around it.
    cell = reach + 1
    near = F.sequence(F.lit(-1), F.lit(1))
    probe = s.withColumn("gx", big(F.floor(F.col("_x") / cell))).withColumn("gz", big(F.floor(F.col("_z") / cell)))
    probe = probe.withColumn("_d", F.explode(near)).withColumn("gx", F.col("gx") + F.col("_d"))
    probe = probe.withColumn("_d", F.explode(near)).withColumn("gz", F.col("gz") + F.col("_d")).drop("_d")
    placed = columns.select("vx", "vz", "surface_y").withColumn("gx", big(F.floor(F.col("vx") / cell))).withColumn("gz", big(F.floor(F.col("vz") / cell)))
    hit = salted_join(placed, probe, ["gx", "gz"], ["vx", "vz"])
    dx, dz = F.col("vx") - F.floor("_x"), F.col("vz") - F.floor("_z")
    hit = hit.where((F.abs(dx) <= reach) & (F.abs(dz) <= reach)).withColumn("_d2", dx * dx + dz * dz)
    best = hit.groupBy("site_id", "i", "j").agg(F.min_by(F.struct("vx", "vz", "surface_y"), F.struct("_d2", "vx", "vz")).alias("_b"))
    return best.select("site_id", big(F.col("i")).alias("i"), big(F.col("j")).alias("j"), "_b.*")
