"""Land use, reservoirs and engineered ground on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geometry import bbox_of_geometry
from ..functions.geo import M_PER_DEG
from ..session import cut_lineage
from .raster import halo_rings
from .skew import pick_rank
from .spatial_join import (
    Grid, polygon_components, rasterize_line_buffer, rasterize_polygons, line_box,
)

CELL = ["r", "c"]
HALO_MAX_DELTA_M = 8.0


def landuse_raster(areas: DataFrame, grid: Grid) -> DataFrame:
    """Land use per touched cell: highest priority, then the latest area.  ``areas``: poly_id, seq, area_type, polygon."""
    typed = first_feature(areas, "poly_id").withColumn("landuse", rules.landuse_class("area_type")).where(F.col("landuse").isNotNull())
    cells = rasterize_polygons(typed, grid, carry=["landuse", "seq"])
    rank = F.struct(rules.landuse_priority("landuse"), "seq")
    return cells.groupBy(*CELL).agg(F.max_by("landuse", rank).alias("landuse"))


def first_feature(features: DataFrame, ident: str, order: str = "seq") -> DataFrame:
    """First row per feature id in input order."""
    rest = [c for c in features.columns if c != ident]
    best = features.groupBy(ident).agg(F.min_by(F.struct(*rest), order).alias("_f"))
    return best.select(ident, "_f.*")


def reservoir_surface(water: DataFrame, heights: DataFrame, grid: Grid) -> DataFrame:
    """Water level of reservoirs per cell.  ``water``: poly_id, water_type, polygon; ``heights``: r, c, z.

    The level is the element at 40 % of the sorted inside heights.  Types in the reservoir list count with five
    cells; other standing water also needs a mean height of 5 m and a box of 0.05 km2.
    """
    standing = water.where(~F.col("water_type").isin(*rules.CHANNEL_TYPES)).withColumn(
        "explicit", F.col("water_type").isin(*rules.RESERVOIR_TYPES)
    )
    box = bbox_of_geometry("polygon")
    area = (box["lat_max"] - box["lat_min"]) * (box["lon_max"] - box["lon_min"]) * M_PER_DEG * M_PER_DEG / 1e6
    standing = standing.where(F.col("explicit") | (F.size("polygon") >= 4)).withColumn("km2", area)
    inside = cut_lineage(
        rasterize_polygons(standing, grid, "centre", carry=["explicit", "km2"]).join(heights, CELL)
    )
    level = pick_rank(inside, ["poly_id"], "z", F.floor(F.col("n") * 0.4), "_level")
    mean = inside.groupBy("poly_id", "explicit", "km2").agg(F.avg("z").alias("_mean"))
    kept = (
        level.join(mean, "poly_id")
        .where((F.col("n") >= 5) & (F.col("explicit") | ((F.col("_mean") >= 5.0) & (F.col("km2") >= 0.05))))
        .select("poly_id", F.greatest("_level", F.lit(0.1)).alias("level_m"))
    )
    wet = inside.join(kept, "poly_id").where(F.col("z") <= F.col("level_m") + 2.0)
    return wet.groupBy(*CELL).agg(F.max("level_m").alias("level_m"))


def bench_target(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median of the lower half of the heights ``z`` of each key's cells."""
    half = F.floor(F.greatest(F.floor((F.col("n") + 1) / 2), F.lit(1)) / 2)
    return pick_rank(cells, keys, "z", half, "target_m").select(*keys, "target_m")


def engineered_ground(areas: DataFrame, heights: DataFrame, grid: Grid, lines: DataFrame | None = None) -> DataFrame:
    """Level and strength of flattened ground per cell.

    ``areas``: poly_id, seq, area_type, polygon (land areas, then closed aeroways).  ``lines``: the same with ``line``
    for open aeroways.  Areas that meet share the lowest bench of their explicit members; weaker support areas join
    only when the component has a seed; higher priority, then strength, then later order wins a cell; halos of up to
    two rings fill cells without strength whose height is within 8 m.
    """
    profile = rules.ground_profile("area_type")

    def profiled(df):
        return df.withColumn("_p", profile).select("*", "_p.*").drop("_p").where(F.col("priority").isNotNull())

    typed = profiled(first_feature(areas, "poly_id"))
    shape = typed.select("poly_id", "polygon")
    cells = rasterize_polygons(typed, grid).select("poly_id", *CELL)
    if lines is not None:
        open_ways = profiled(first_feature(lines, "poly_id")).where(F.col("line_half_width_m").isNotNull())
        box = line_box("line", F.col("line_half_width_m"))

        def corner(a, b):
            return F.struct(box[a].alias("lat"), box[b].alias("lon"))

        ring = F.array(corner("lat_min", "lon_min"), corner("lat_min", "lon_max"), corner("lat_max", "lon_max"), corner("lat_max", "lon_min"))
        shape = shape.unionByName(open_ways.select("poly_id", ring.alias("polygon")))
        cells = cells.unionByName(rasterize_line_buffer(open_ways, grid, F.col("line_half_width_m")).select("poly_id", *CELL))
        typed = typed.drop("polygon").unionByName(open_ways.drop("line"))
    else:
        typed = typed.drop("polygon")
    cells = cut_lineage(cells.distinct())
    shape = cut_lineage(shape.join(cells.select("poly_id").distinct(), "poly_id", "left_semi"))
    comp = cut_lineage(polygon_components(shape, "poly_id"))

    explicit = typed.where(F.col("kind") == "explicit").select("poly_id")
    tall = cells.join(explicit, "poly_id", "left_semi").join(heights, CELL)
    full = bench_target(tall, ["poly_id"])
    centre_src = areas.join(explicit, "poly_id", "left_semi")
    centre_cells = rasterize_polygons(first_feature(centre_src, "poly_id"), grid, "centre").select("poly_id", *CELL).join(heights, CELL)
    centre = bench_target(centre_cells, ["poly_id"]).withColumnRenamed("target_m", "_c")
    own = full.join(centre, "poly_id", "left").select("poly_id", F.least("target_m", F.coalesce("_c", "target_m")).alias("own_m"))
    group = (
        typed.select("poly_id", "seeds_support").join(comp, "poly_id").join(own, "poly_id", "left")
        .groupBy("component").agg(F.min("own_m").alias("level_m"), F.max("seeds_support").alias("seeded"))
        .where(F.col("level_m").isNotNull())
    )
    active = typed.join(comp, "poly_id").join(group, "component").where((F.col("kind") == "explicit") | F.col("seeded"))
    active = cut_lineage(active.select("poly_id", "seq", "priority", "boundary_strength", "interior_strength", "halo1", "halo2", "level_m"))

    # A cell is interior when its whole 3x3 block belongs to the area; cells outside the grid never do.
    span = F.sequence(F.lit(-1), F.lit(1))
    votes = (
        cells.withColumn("_dr", F.explode(span)).withColumn("_dc", F.explode(span))
        .select("poly_id", (F.col("r") + F.col("_dr")).alias("r"), (F.col("c") + F.col("_dc")).alias("c"))
        .groupBy("poly_id", *CELL).agg(F.count(F.lit(1)).alias("_votes"))
    )
    marked = cells.join(votes, ["poly_id", *CELL]).join(active, "poly_id")
    strength = F.when(F.col("_votes") == 9, F.col("interior_strength")).otherwise(F.col("boundary_strength"))
    inside = marked.withColumn("_s", strength).groupBy(*CELL).agg(
        F.max_by(F.struct("level_m", F.col("_s").alias("strength")), F.struct("priority", "_s", "seq")).alias("_w")
    ).select(*CELL, "_w.*")
    inside = cut_lineage(inside)

    haloed = active.where(F.col("halo1").isNotNull())
    rings = halo_rings(cells.join(haloed.select("poly_id"), "poly_id", "left_semi"), ["poly_id"])
    halo = (
        rings.join(haloed, "poly_id").join(heights, CELL).join(inside.select(*CELL), CELL, "left_anti")
        .where(F.abs(F.col("z") - F.col("level_m")) <= HALO_MAX_DELTA_M)
        .groupBy(*CELL)
        .agg(F.min_by(F.struct("level_m", F.when(F.col("ring") == 1, F.col("halo1")).otherwise(F.col("halo2")).alias("strength")), "seq").alias("_h"))
        .select(*CELL, "_h.*")
    )
    return inside.unionByName(halo)
