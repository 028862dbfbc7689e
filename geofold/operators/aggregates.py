"""Statistics and counts used by reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import big
from .skew import pick_rank


def scalar_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, maximum, mean and nearest-rank 95th percentile per group."""
    keys = list(keys)
    basic = df.groupBy(*keys).agg(
        F.min(value).alias(f"{value}_min"), F.max(value).alias(f"{value}_max"), F.avg(value).alias(f"{value}_mean")
    )
    p95 = pick_rank(df, keys, value, F.round((F.col("n") - 1) * 0.95), f"{value}_p95").drop("n")
    return basic.join(p95, keys) if keys else basic.withColumn("_k", F.lit(0)).join(p95.withColumn("_k", F.lit(0)), "_k").drop("_k")


def changed_fraction(df: DataFrame, before: str, after: str, keys: Sequence[str] = ()) -> DataFrame:
    """Cells whose value moved by more than 1e-6: count and share."""
    moved = F.count_if(F.abs(F.col(after) - F.col(before)) > 1e-6)
    return df.groupBy(*keys).agg(moved.alias("changed"), (moved / F.count(F.lit(1))).alias("fraction"))


def coverage_mode(engineered: str, context: str):
    """How a site is covered, from its counts."""
    return (
        F.when(F.col(engineered) > 0, "engineered_ground_active")
        .when(F.col(context) > 0, "osm_context_only")
        .otherwise("dem_only")
    )


def material_histogram(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Voxels by material over column runs ``y0..y1``, most frequent first within the caller's sort."""
    return runs.groupBy(*keys, "material").agg(F.sum(F.col("y1") - F.col("y0") + 1).alias("n"))


def column_top(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest run of each column that is not air."""
    solid = runs.where(F.col("material") != "AIR")
    return solid.groupBy(*keys).agg(F.max("y1").alias("top_y"), F.max_by("material", "y1").alias("top_material"))


def column_ground(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest run of each column that is not air, water, leaves or wood."""
    solid = runs.where(~F.col("material").isin("AIR", "WATER", "LEAVES", "WOOD"))
    return solid.groupBy(*keys).agg(F.max("y1").alias("ground_y"), F.max_by("material", "y1").alias("ground_material"))


def chunk_summary(runs: DataFrame, chunk: Sequence[str], column: Sequence[str] = ("vx", "vz")) -> DataFrame:
    """Per chunk: non-air voxels, columns with water, road and building tops, ground range."""
    keys = [*chunk, *column]
    solid = ~F.col("material").isin("AIR", "WATER", "LEAVES", "WOOD")
    per_column = runs.groupBy(*keys).agg(
        F.sum(F.when(F.col("material") != "AIR", F.col("y1") - F.col("y0") + 1).otherwise(0)).alias("_n"),
        F.max(F.col("material") == "WATER").alias("_water"),
        F.max(F.col("material") == "ASPHALT").alias("_road"),
        F.max(F.col("material").isin("CONCRETE", "BRICK", "GLASS", "STEEL")).alias("_built"),
        F.max(F.when(solid, F.col("y1"))).alias("_ground"),
    )
    return per_column.groupBy(*chunk).agg(
        F.sum("_n").alias("non_air"), F.count_if("_water").alias("water_columns"), F.count_if("_road").alias("road_columns"),
        F.count_if("_built").alias("building_columns"), F.min("_ground").alias("ground_min"), F.max("_ground").alias("ground_max"),
    )


def surface_reconstruct(runs: DataFrame, chunk: Sequence[str] = ("cx", "cz"), height: int = 200) -> DataFrame:
    """Surface height of each column and layer from its runs.

    Top solid + 0.5; an empty column gives min - 1; a column full to its top with solid ground in the layer above gives
    max + 2.  A stored value is kept unless the top is road-like or it is off by more than one.
    ``runs``: chunk keys, cy, vx, vz, y0, y1, material, stored.
    """
    keys = [*chunk, "vx", "vz"]
    solid = ~F.col("material").isin("AIR", "WATER", "LEAVES", "WOOD")
    top = runs.groupBy(*keys, "cy").agg(
        F.max(F.when(solid, F.col("y1"))).alias("_top"), F.max_by("material", F.when(solid, F.col("y1"))).alias("_mat"),
        F.max("stored").alias("stored"),
    )
    above = top.select(*keys, (F.col("cy") - 1).alias("cy"), F.col("_top").isNotNull().alias("_above"))
    j = top.join(above, [*keys, "cy"], "left")
    lo, hi = F.col("cy") * height, F.col("cy") * height + height - 1
    rebuilt = (
        F.when(F.col("_top").isNull(), lo - 1.0)
        .when((F.col("_top") >= hi) & F.coalesce("_above", F.lit(False)), hi + 1 + 2.0)
        .otherwise(F.col("_top") + 0.5)
    ).cast("double")
    j = j.withColumn("_r", rebuilt)
    road = F.coalesce(F.col("_mat").isin("ASPHALT", "CONCRETE", "GRAVEL"), F.lit(False))
    use = F.col("stored").isNull() | road | (F.abs(F.col("stored") - F.col("_r")) > 1.0)
    return j.select(*keys, "cy", F.when(use, F.col("_r")).otherwise(F.col("stored")).alias("surface_y"))
