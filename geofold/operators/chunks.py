"""Chunk grid helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import CHUNK_X, CHUNK_Y, CHUNK_Z, big, chunk_of, chunk_of_voxel, col, gps_to_ecef, voxel_of_ecef


def chunk_bounds(chunks: DataFrame) -> DataFrame:
    """Half-open voxel bounds of chunks ``cx, cy, cz``."""
    out = chunks
    for axis, size in (("x", CHUNK_X), ("y", CHUNK_Y), ("z", CHUNK_Z)):
        lo = F.col(f"c{axis}") * size
        out = out.withColumn(f"{axis}0", lo).withColumn(f"{axis}1", lo + size)
    return out


def chunk_contains(cx, cy, cz, vx, vy, vz) -> Column:
    inside = F.lit(True)
    for c, v, size in ((cx, vx, CHUNK_X), (cy, vy, CHUNK_Y), (cz, vz, CHUNK_Z)):
        inside = inside & (col(v) >= col(c) * size) & (col(v) < col(c) * size + size)
    return inside


def _steps(lo: int, hi: int) -> Column:
    return F.explode(F.sequence(F.lit(lo), F.lit(hi)))


def chunk_neighbours(chunks: DataFrame) -> DataFrame:
    """The 26 chunks around each chunk."""
    out = chunks.withColumn("_dx", _steps(-1, 1)).withColumn("_dy", _steps(-1, 1)).withColumn("_dz", _steps(-1, 1))
    out = out.where((F.col("_dx") != 0) | (F.col("_dy") != 0) | (F.col("_dz") != 0))
    for a in "xyz":
        out = out.withColumn(f"n{a}", F.col(f"c{a}") + F.col(f"_d{a}"))
    return out.drop("_dx", "_dy", "_dz")


def affected_chunks(vx, vy, vz) -> Column:
    """Chunks holding a mesh cube with this voxel as a corner: 1, 2, 4 or 8."""
    vx, vy, vz = col(vx), col(vy), col(vz)
    return F.array_distinct(
        F.array(*[chunk_of_voxel(vx + dx, vy + dy, vz + dz) for dx in (-1, 0) for dy in (-1, 0) for dz in (-1, 0)])
    )


def op_chunks(action, coord, box_min, box_max) -> Column:
    """Chunks an operation touches; empty for actions without a place."""
    action, coord, lo, hi = col(action), col(coord), col(box_min), col(box_max)

    def span(axis, size):
        return F.sequence(chunk_of(lo[axis], size), chunk_of(hi[axis], size))

    box = F.flatten(
        F.transform(
            span("x", CHUNK_X),
            lambda x: F.flatten(
                F.transform(
                    span("y", CHUNK_Y),
                    lambda y: F.transform(
                        span("z", CHUNK_Z), lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
                    ),
                )
            ),
        )
    )
    return (
        F.when(action.isin("SetVoxel", "RemoveVoxel"), affected_chunks(coord["x"], coord["y"], coord["z"]))
        .when(action == "FillRegion", box)
        .otherwise(F.array().cast("array<struct<x:bigint,y:bigint,z:bigint>>"))
    )


def chunks_in_manhattan(chunks: DataFrame, radius: int) -> DataFrame:
    """Chunks within a horizontal Manhattan radius; replaces ``cx, cz``."""
    out = chunks.withColumn("_dx", _steps(-radius, radius)).withColumn("_dz", _steps(-radius, radius))
    out = out.where(F.abs("_dx") + F.abs("_dz") <= radius)
    return (
        out.withColumn("cx", F.col("cx") + F.col("_dx")).withColumn("cz", F.col("cz") + F.col("_dz")).drop("_dx", "_dz")
    )


def chunks_in_radius(viewers: DataFrame, radius_m: float) -> DataFrame:
    """Chunks whose centre lies within ``radius_m`` of a voxel position ``vx, vy, vz``; adds ``cx, cy, cz, dist_m``."""
    out, square = viewers, F.lit(0.0)
    for a, size in (("x", CHUNK_X), ("y", CHUNK_Y), ("z", CHUNK_Z)):
        v = F.col(f"v{a}")
        span = F.sequence(chunk_of(v - radius_m - size, size), chunk_of(v + radius_m + size, size))
        out = out.withColumn(f"c{a}", F.explode(span))
        d = F.col(f"c{a}") * size + size / 2 - v
        square = square + d * d
    return out.withColumn("dist_m", F.sqrt(square)).where(F.col("dist_m") <= radius_m)


def enumerate_chunks(regions: DataFrame, extra_layers: int = 0) -> DataFrame:
    """Chunks of a region from its corners at three heights and its height range.

    ``regions``: region, lat_min, lat_max, lon_min, lon_max, z_min, z_max, origin_alt, origin_vy.
    """
    heights = F.when(F.abs(F.col("z_max") - F.col("z_min")) < 2.3e-16, F.array("origin_alt")).otherwise(
        F.array("z_min", "origin_alt", "z_max")
    )
    corner = (
        regions.withColumn("_h", F.explode(heights))
        .withColumn("_lat", F.explode(F.array("lat_min", "lat_max")))
        .withColumn("_lon", F.explode(F.array("lon_min", "lon_max")))
        .withColumn("_p", gps_to_ecef("_lat", "_lon", "_h"))
    )

    def level(z):
        return F.col("origin_vy") + F.col(z) - F.col("origin_alt")

    spans = corner.groupBy("region").agg(
        F.min(chunk_of(voxel_of_ecef("_p.x"), CHUNK_X)).alias("x0"), F.max(chunk_of(voxel_of_ecef("_p.x"), CHUNK_X)).alias("x1"),
        F.min(chunk_of(voxel_of_ecef("_p.z"), CHUNK_Z)).alias("z0"), F.max(chunk_of(voxel_of_ecef("_p.z"), CHUNK_Z)).alias("z1"),
        (F.min(chunk_of(F.floor(level("z_min")), CHUNK_Y)) - 1).alias("y0"),
        (F.max(chunk_of(F.ceil(level("z_max")), CHUNK_Y)) + extra_layers).alias("y1"),
    )
    out = spans.withColumn("cx", F.explode(F.sequence("x0", "x1"))).repartition("region", "cx")
    return (
        out.withColumn("cz", F.explode(F.sequence("z0", "z1")))
        .withColumn("cy", F.explode(F.sequence("y0", "y1")))
        .select("region", *[big(F.col(c)).alias(c) for c in ("cx", "cy", "cz")])
    )


def nearest_chunks(desired: DataFrame, loaded: DataFrame) -> DataFrame:
    """Desired chunks not loaded yet, nearest first, as ``rank`` per viewer."""
    from pyspark.sql import Window

    w = Window.partitionBy("viewer").orderBy("dist_m", "cx", "cy", "cz")
    missing = desired.join(loaded.select("viewer", "cx", "cy", "cz"), ["viewer", "cx", "cy", "cz"], "left_anti")
    return missing.withColumn("rank", big(F.row_number().over(w)))
