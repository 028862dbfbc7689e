"""Height lookups on grids and elevation tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import big, clamp, col
from .skew import pick_rank, salted_join
from .spatial_join import Grid

VOID = -32768
VOID_ALT = -9999
CLIFF_M = 15.0
FILL_STEP_DEG = 0.5 / 3600.0


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell of a grid with the position of its node; generated in parallel from the extent."""
    cells = spark.range(grid.rows * grid.cols).select(
        F.lit(grid.region).alias("region"),
        big(F.floor(F.col("id") / grid.cols)).alias("r"), (F.col("id") % grid.cols).alias("c"),
    )
    return cells.withColumn("lat", F.col("r") * grid.step + grid.lat_min).withColumn("lon", F.col("c") * grid.step + grid.lon_min)


def dem_bilinear(points: DataFrame, cells: DataFrame, grid: Grid, point_id: Sequence[str]) -> DataFrame:
    """Bilinear height at points ``lat, lon``; the grid's edge cells are repeated outside it.

    Where a corner has no height the result is the mean of those that have one; without any, the point gets no row.
    """
    point_id = list(point_id)
    fr, fc = (F.col("lat") - grid.lat_min) / grid.step, (F.col("lon") - grid.lon_min) / grid.step
    r0, c0 = F.floor(fr), F.floor(fc)
    tr, tc = fr - r0, fc - c0
    corners = F.array(
        *[
            F.struct(
                big(clamp(r0 + i, 0, grid.rows - 1)).alias("r"), big(clamp(c0 + j, 0, grid.cols - 1)).alias("c"),
                ((tr if i else 1.0 - tr) * (tc if j else 1.0 - tc)).alias("w"),
            )
            for i in (0, 1) for j in (0, 1)
        ]
    )
    asked = points.select(*point_id, F.explode(corners).alias("k")).select(*point_id, F.col("k.r").alias("_kr"), F.col("k.c").alias("_kc"), "k.w")
    found = salted_join(asked, cells.select(F.col("r").alias("_kr"), F.col("c").alias("_kc"), "z").where(F.col("z").isNotNull()), ["_kr", "_kc"], point_id)
    four = F.count(F.lit(1)) == 4
    return found.groupBy(*point_id).agg(F.when(four, F.sum(F.col("z") * F.col("w"))).otherwise(F.avg("z")).alias("z"))


def dem_sample(points: DataFrame, tiles: DataFrame, point_id: Sequence[str], side: int, cliff_m: float | None = CLIFF_M) -> DataFrame:
    """Height at points from tiles ``(tile_lat, tile_lon, prow, pcol, elev_m)``, row 0 north.

    Four valid corners: bilinear, or the nearest when an edge differs by more than ``cliff_m`` (None: never).  Some
    valid: their mean.  None valid: the minimum of the 17 x 17 pixels around, else 0.  Points whose tile is absent
    get no row.
    """
    point_id, n = list(point_id), side - 1
    tile_key = ["tile_lat", "tile_lon"]
    p = points.select(*point_id, "lat", "lon", big(F.floor("lat")).alias("tile_lat"), big(F.floor("lon")).alias("tile_lon"))
    fr, fc = (F.col("tile_lat") + 1 - F.col("lat")) * n, (F.col("lon") - F.col("tile_lon")) * n
    p = p.withColumn("_r", big(clamp(F.floor(fr), 0, side - 2))).withColumn("_c", big(clamp(F.floor(fc), 0, side - 2)))
    p = p.withColumn("_fr", fr - F.col("_r")).withColumn("_fc", fc - F.col("_c"))
    have = tiles.select(*tile_key).distinct()
    p = p.join(have, tile_key, "left_semi")
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    asked = p.withColumn("_o", F.explode(offs)).withColumn("prow", F.col("_r") + F.col("_o.i")).withColumn("pcol", F.col("_c") + F.col("_o.j"))
    pixels = tiles.select(*[big(F.col(c)).alias(c) for c in (*tile_key, "prow", "pcol")], F.col("elev_m").cast("double").alias("_v"))
    valid = pixels.where(~F.col("_v").isin(VOID, VOID_ALT))
    got = salted_join(asked, valid, [*tile_key, "prow", "pcol"], point_id, "left")

    def at(i, j):
        return F.max(F.when((F.col("_o.i") == i) & (F.col("_o.j") == j), F.col("_v")))

    four = got.groupBy(*point_id, *tile_key, "_r", "_c", "_fr", "_fc").agg(
        at(0, 0).alias("e00"), at(0, 1).alias("e01"), at(1, 0).alias("e10"), at(1, 1).alias("e11"),
        F.count("_v").alias("_n"), F.avg("_v").alias("_mean"),
    )
    e00, e01, e10, e11 = (F.col(c) for c in ("e00", "e01", "e10", "e11"))
    smooth = (e00 * (1 - F.col("_fc")) + e01 * F.col("_fc")) * (1 - F.col("_fr")) + (e10 * (1 - F.col("_fc")) + e11 * F.col("_fc")) * F.col("_fr")
    near = F.when(F.col("_fr") < 0.5, F.when(F.col("_fc") < 0.5, e00).otherwise(e01)).otherwise(F.when(F.col("_fc") < 0.5, e10).otherwise(e11))
    step = F.greatest(F.abs(e00 - e01), F.abs(e00 - e10), F.abs(e01 - e11), F.abs(e10 - e11))
    full = smooth if cliff_m is None else F.when(step > cliff_m, near).otherwise(smooth)
    four = four.withColumn("z", F.when(F.col("_n") == 4, full).when(F.col("_n") > 0, F.col("_mean")))
    # Only points without any valid corner look further.
    far = (
        four.where(F.col("_n") == 0).select(*point_id, *tile_key, "_r", "_c")
        .withColumn("prow", F.explode(F.sequence(F.col("_r") - 8, F.col("_r") + 8)))
        .withColumn("pcol", F.explode(F.sequence(F.col("_c") - 8, F.col("_c") + 8)))
        .join(valid, [*tile_key, "prow", "pcol"]).groupBy(*point_id).agg(F.min("_v").alias("_far"))
    )
    return four.join(far, point_id, "left").select(*point_id, F.coalesce("z", "_far", F.lit(0.0)).alias("z"))


def dem_fill_neighbours(points: DataFrame, sample, point_id: Sequence[str], offset_m: float = 0.0) -> DataFrame:
    """Height by ``sample(points, ids)``; where it gives none, the mean of the samples half an arc-second away."""
    point_id = list(point_id)
    raw = sample(points, point_id)
    missing = points.join(raw.select(*point_id), point_id, "left_anti")
    d = FILL_STEP_DEG
    shifts = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((d, 0.0), (-d, 0.0), (0.0, d), (0.0, -d))])
    around = missing.select(*point_id, "lat", "lon", F.posexplode(shifts).alias("_k", "_s")).select(
        *point_id, "_k", (F.col("lat") + F.col("_s.dy")).alias("lat"), (F.col("lon") + F.col("_s.dx")).alias("lon")
    )
    filled = sample(around, [*point_id, "_k"]).groupBy(*point_id).agg(F.avg("z").alias("z"))
    return raw.select(*point_id, "z").unionByName(filled).withColumn("z", F.col("z") + offset_m)


def dem_source_priority(points: DataFrame, answers: Sequence[DataFrame], point_id: Sequence[str]) -> DataFrame:
    """First source that answers wins per point; each answer is ``point_id, z``."""
    tagged = None
    for i, a in enumerate(answers):
        a = a.where(F.col("z").isNotNull()).select(*point_id, "z", F.lit(i).cast("bigint").alias("source"))
        tagged = a if tagged is None else tagged.unionByName(a)
    best = tagged.groupBy(*point_id).agg(F.min_by(F.struct("z", "source"), "source").alias("_b")).select(*point_id, "_b.*")
    return points.select(*point_id).join(best, list(point_id), "left")


def dem_range(cells: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Lowest and highest plausible height."""
    ok = cells.where(rules.dem_plausible("z"))
    return ok.groupBy(*keys).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def datum_offset(cells: DataFrame, keys: Sequence[str] = ("region",), edge_deg: float = 0.5) -> DataFrame:
    """Height correction per region: minus the upper median of the lowest 2 % (1 to 30) of the candidate cells.

    Candidates lie near the region's edge or below 20 m, and not below -50 m.  It applies when that median is between
    -8 and 12 m.  ``cells``: keys, lat, lon (cell centre), z, and the extent lat_min, lat_max, lon_min, lon_max.
    """
    keys = list(keys)
    near = (
        (F.col("lat") < F.col("lat_min") + edge_deg) | (F.col("lat") > F.col("lat_max") - edge_deg)
        | (F.col("lon") < F.col("lon_min") + edge_deg) | (F.col("lon") > F.col("lon_max") - edge_deg)
    )
    low = cells.where((F.col("z") >= -50.0) & (near | (F.col("z") < 20.0)))
    rank = F.floor(F.least(F.greatest(F.floor(F.col("n") / 50), F.lit(1)), F.lit(30)) / 2)
    median = pick_rank(low, keys, "z", rank, "median_m")
    plausible = (F.col("median_m") > -8.0) & (F.col("median_m") < 12.0)
    return median.select(*keys, "median_m", F.when(plausible, -F.col("median_m")).otherwise(0.0).alias("offset_m"))


def sample_grid(spark: SparkSession, grid: Grid, sample) -> DataFrame:
    """The grid's nodes, each sampled; missing heights are 0."""
    cells = grid_cells(spark, grid)
    return cells.join(sample(cells, ["r", "c"]), ["r", "c"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def sample_region(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float, step: float, sample) -> DataFrame:
    """Grid of points over a box, each sampled; missing heights are 0."""
    import math

    return sample_grid(spark, Grid(lat_min, lon_min, step, math.ceil((lat_max - lat_min) / step) + 1, math.ceil((lon_max - lon_min) / step) + 1), sample)


def upsample_grid(samples: DataFrame, spacing: int = 30, cliff_m: float = 4.0) -> DataFrame:
    """One-metre columns from samples ``(region, i, j, z)`` spaced ``spacing`` apart.

    Each cell of four samples is one row, expanded to spacing x spacing columns; nearest sample when an edge of the
    cell differs by more than ``cliff_m``, else bilinear.
    """
    from .raster import neighbours

    near = neighbours(samples.withColumnRenamed("i", "r").withColumnRenamed("j", "c"))
    cell = near.where(F.col("z_ne").isNotNull()).select(
        "region", F.col("r").alias("i"), F.col("c").alias("j"),
        F.col("z").alias("e00"), F.col("z_e").alias("e01"), F.col("z_n").alias("e10"), F.col("z_ne").alias("e11"),
    )
    e00, e01, e10, e11 = (F.col(c) for c in ("e00", "e01", "e10", "e11"))
    step = F.greatest(F.abs(e00 - e01), F.abs(e00 - e10), F.abs(e01 - e11), F.abs(e10 - e11))
    span = F.sequence(F.lit(0), F.lit(spacing - 1))
    out = cell.withColumn("_step", step).withColumn("_a", F.explode(span)).withColumn("_b", F.explode(span))
    fi, fj = F.col("_a") / spacing, F.col("_b") / spacing
    nearest = F.when(fi < 0.5, F.when(fj < 0.5, e00).otherwise(e01)).otherwise(F.when(fj < 0.5, e10).otherwise(e11))
    smooth = (e00 * (1 - fj) + e01 * fj) * (1 - fi) + (e10 * (1 - fj) + e11 * fj) * fi
    return out.select(
        "region", (F.col("i") * spacing + F.col("_a")).alias("x"), (F.col("j") * spacing + F.col("_b")).alias("y"),
        F.when(F.col("_step") > cliff_m, nearest).otherwise(smooth).alias("z"),
    )
