"""The Column functions for SQL users: temporary functions whose bodies are the expressions themselves.

A body is the SQL of the analysed expression, so the optimiser sees through the call and nothing runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import geo, rules

POINT = [("lat", "double"), ("lon", "double")]
TWO = [("lat1", "double"), ("lon1", "double"), ("lat2", "double"), ("lon2", "double")]
#: Name -> (Column function, its arguments in order).
FUNCTIONS: dict[str, tuple[Callable[..., Column], list[tuple[str, str]]]] = {
    "gps_to_ecef": (geo.gps_to_ecef, [*POINT, ("alt", "double")]),
    "ecef_to_gps": (geo.ecef_to_gps, [("x", "double"), ("y", "double"), ("z", "double")]),
    "haversine_m": (geo.haversine_m, TWO),
    "bearing_deg": (geo.bearing_deg, TWO),
    "offset_lat_lon": (geo.offset_lat_lon, [*POINT, ("north_m", "double"), ("east_m", "double")]),
    "geoid_undulation": (geo.geoid_undulation, POINT),
    "wrap_lon": (geo.wrap_lon, [("lon", "double"), ("reference", "double")]),
    "voxel_of_ecef": (geo.voxel_of_ecef, [("v", "double")]),
    "ecef_of_voxel": (geo.ecef_of_voxel, [("v", "bigint")]),
    "column_gps": (geo.column_gps, [("vx", "bigint"), ("vz", "bigint"), ("origin_y", "double")]),
    "tile_key": (geo.tile_key, [("deg", "double")]),
    "chunk_of_voxel": (geo.chunk_of_voxel, [("vx", "bigint"), ("vy", "bigint"), ("vz", "bigint")]),
    "angle_lerp": (geo.angle_lerp, [("a", "double"), ("b", "double"), ("t", "double")]),
    "climate_zone": (rules.climate_zone, [("lat", "double"), ("elev", "double")]),
    "moisture_class": (rules.moisture_class, [("twi", "double")]),
    "likely_river": (rules.likely_river, [("acc", "double"), ("slope", "double")]),
    "likely_cliff": (rules.likely_cliff, [("slope", "double"), ("tri", "double")]),
    "road_width_m": (rules.road_width_m, [("cls", "string")]),
    "road_paved": (rules.road_paved, [("cls", "string")]),
    "building_height": (rules.building_height, [("tags", "map<string,string>")]),
    "engineered_height": (rules.engineered_height, [("source", "double"), ("target", "double"), ("strength", "double")]),
    "ortho_to_voxel_y": (rules.ortho_to_voxel_y, [("height", "double"), *POINT, ("origin_alt", "double"), ("origin_vy", "bigint")]),
    "dem_plausible": (rules.dem_plausible, [("z", "double")]),
}


def sql_body(spark: SparkSession, fn: Callable[..., Column], arguments: list[tuple[str, str]]) -> str:
    """SQL of ``fn`` applied to its arguments by name."""
    row = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in arguments])
    plan = row.select(fn(*[F.col(name) for name, _ in arguments]).alias("_out"))._jdf.queryExecution().analyzed()
    return plan.projectList().head().child().sql()


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions in the session, under their names with ``prefix``; returns the names."""
    names = []
    for name, (fn, arguments) in FUNCTIONS.items():
        head = ", ".join(f"{a} {kind}" for a, kind in arguments)
        spark.sql(f"create or replace temporary function {prefix}{name}({head}) return {sql_body(spark, fn, arguments)}")
        names.append(prefix + name)
    return names
