"""Geodesy and grid-key Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 axes, mean radius, metres per degree, grid sizes.
WGS84_A = 6378137.0
WGS84_B = 6356752.3142
EARTH_R = 6371000.0
M_PER_DEG = 111320.0
WORLD_OFFSET_M = 6400000.0
TILE_DEG = 0.01
CHUNK_X, CHUNK_Y, CHUNK_Z = 30, 200, 30
OBJECT_CELL_M = 64.0
REGION_DEG = {0: 10.0, 1: 1.0, 2: 0.1, 3: 0.01}

_E2 = 1.0 - (WGS84_B * WGS84_B) / (WGS84_A * WGS84_A)
_EP2 = (WGS84_A * WGS84_A) / (WGS84_B * WGS84_B) - 1.0


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def big(c: Column) -> Column:
    return c.cast("bigint")


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, col(lo)), col(hi))


def flat_scale_lon(lat: Column) -> Column:
    """Metres per degree of longitude, with the cosine floored at 0.1."""
    return F.lit(M_PER_DEG) * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(0.1))


def gps_to_ecef(lat, lon, alt) -> Column:
    lat, lon, alt = F.radians(col(lat)), F.radians(col(lon)), col(alt)
    n = F.lit(WGS84_A) / F.sqrt(F.lit(1.0) - F.lit(_E2) * F.sin(lat) * F.sin(lat))
    return F.struct(
        ((n + alt) * F.cos(lat) * F.cos(lon)).alias("x"),
        ((n + alt) * F.cos(lat) * F.sin(lon)).alias("y"),
        ((n * F.lit(1.0 - _E2) + alt) * F.sin(lat)).alias("z"),
    )


def ecef_to_gps(x, y, z) -> Column:
    """Bowring's closed form with his start for heights; under a micrometre from the surface to low orbit."""
    x, y, z = col(x), col(y), col(z)
    p = F.sqrt(x * x + y * y)
    r = F.sqrt(x * x + y * y + z * z)
    theta = F.atan2(z * F.lit(WGS84_B) * (F.lit(1.0) + F.lit(_EP2 * WGS84_B) / r), p * F.lit(WGS84_A))
    lat = F.atan2(
        z + F.lit(_EP2 * WGS84_B) * F.pow(F.sin(theta), F.lit(3.0)),
        p - F.lit(_E2 * WGS84_A) * F.pow(F.cos(theta), F.lit(3.0)),
    )
    alt = (
        p * F.cos(lat)
        + z * F.sin(lat)
        - F.lit(WGS84_A) * F.sqrt(F.lit(1.0) - F.lit(_E2) * F.sin(lat) * F.sin(lat))
    )
    return F.struct(F.degrees(lat).alias("lat"), F.degrees(F.atan2(y, x)).alias("lon"), alt.alias("alt"))


def ecef_distance(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = col(ax) - col(bx), col(ay) - col(by), col(az) - col(bz)
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = col(lat1), col(lon1), col(lat2), col(lon2)
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return F.lit(2 * EARTH_R) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    la1, la2 = F.radians(col(lat1)), F.radians(col(lat2))
    dlon = F.radians(col(lon2) - col(lon1))
    east = F.sin(dlon) * F.cos(la2)
    north = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def offset_lat_lon(lat, lon, north_m, east_m) -> Column:
    lat, lon = col(lat), col(lon)
    return F.struct(
        (lat + col(north_m) / M_PER_DEG).alias("lat"),
        (lon + col(east_m) / flat_scale_lon(lat)).alias("lon"),
    )


def bbox_for_site(lat, lon, window_m) -> Column:
    lat, lon, half = col(lat), col(lon), col(window_m) * 0.5
    dlat, dlon = half / M_PER_DEG, half / flat_scale_lon(lat)
    return F.struct(
        (lat - dlat).alias("lat_min"),
        (lat + dlat).alias("lat_max"),
        (lon - dlon).alias("lon_min"),
        (lon + dlon).alias("lon_max"),
    )


def geoid_undulation(lat, lon) -> Column:
    """Approximate geoid height: four regional linear patches, then a zonal fallback.

    Terms are added from left to right as in its SQL, since another order differs in the last bit, which moves heights at
    a whole metre to the next.
    """
    lat = col(lat)
    lon360 = F.pmod(col(lon), F.lit(360.0))
    oceania = lat.between(-50.0, -10.0) & lon360.between(110.0, 180.0)
    europe = lat.between(35.0, 72.0) & ((lon360 <= 30.0) | (lon360 >= 350.0))
    america = lat.between(24.0, 55.0) & lon360.between(255.0, 300.0)
    indian = lat.between(-10.0, 15.0) & lon360.between(60.0, 100.0)
    sine = F.sin(F.radians(lat))
    sin2, sin4 = F.pow(sine, F.lit(2.0)), F.pow(sine, F.lit(4.0))
    low = F.sqrt(F.pow(lat - 5.0, F.lit(2.0)) + F.pow(lon360 - 78.0, F.lit(2.0)))
    return (
        F.when(oceania, clamp(F.lit(33.2) - (lat + 27.0) * 0.38 + (lon360 - 153.0) * 0.14, 20.0, 45.0))
        .when(europe, clamp(F.lit(47.0) - (lat - 53.0) * 0.35, 30.0, 60.0))
        .when(america, clamp(F.lit(-18.0) - (lat - 40.0) * 0.4 + (lon360 - 280.0) * 0.12, -40.0, 15.0))
        .when(indian, F.least(F.lit(-100.0) + low * 1.2, F.lit(-20.0)))
        .otherwise(clamp(F.lit(10.0) - (sin2 * 3.0 - 1.0) * 15.0 + (sin4 * 35.0 - sin2 * 30.0 + 3.0) * 1.5, -110.0, 85.0))
    )


def wrap_lon(lon, reference) -> Column:
    """Shift ``lon`` by whole turns until it lies within 180 degrees of ``reference``."""
    d = col(lon) - col(reference)
    turns = F.when(d > 180.0, F.ceil((d - 180.0) / 360.0)).when(d < -180.0, -F.ceil((-d - 180.0) / 360.0))
    return col(lon) - F.coalesce(turns, F.lit(0)) * 360.0


def voxel_of_ecef(v) -> Column:
    return big(F.floor(col(v) + WORLD_OFFSET_M))


def ecef_of_voxel(v) -> Column:
    return col(v) + 0.5 - WORLD_OFFSET_M


def column_gps(vx, vz, origin_y) -> Column:
    """Voxel column to (lat, lon): solve the ellipsoid for Y, keeping the sign of the origin."""
    x, z, oy = ecef_of_voxel(vx), ecef_of_voxel(vz), col(origin_y)
    y2 = F.lit(WGS84_A**2) * (F.lit(1.0) - F.pow(z / WGS84_B, F.lit(2.0))) - x * x
    y = F.when(y2 > 0, F.sqrt(F.greatest(y2, F.lit(0.0))) * F.signum(oy)).otherwise(oy)
    return ecef_to_gps(x, y, z)


def tile_key(deg) -> Column:
    return big(F.floor(col(deg) / TILE_DEG))


def chunk_of(v, size: int) -> Column:
    return big(F.floor(col(v) / size))


def chunk_of_voxel(vx, vy, vz) -> Column:
    return F.struct(
        chunk_of(vx, CHUNK_X).alias("x"), chunk_of(vy, CHUNK_Y).alias("y"), chunk_of(vz, CHUNK_Z).alias("z")
    )


def chunk_gps_box(chunk_x, chunk_z, origin_y, pad_deg: float = 0.00015) -> Column:
    """Footprint in degrees from the four corner columns of a chunk, padded on each side."""
    x0, z0 = col(chunk_x) * CHUNK_X, col(chunk_z) * CHUNK_Z
    corners = F.array(
        *[F.struct((x0 + dx).alias("x"), (z0 + dz).alias("z")) for dx in (0, CHUNK_X - 1) for dz in (0, CHUNK_Z - 1)]
    )
    at = F.transform(corners, lambda c: column_gps(c["x"], c["z"], origin_y))
    lats, lons = F.transform(at, lambda g: g["lat"]), F.transform(at, lambda g: g["lon"])
    return F.struct(
        (F.array_min(lats) - pad_deg).alias("lat_min"),
        (F.array_max(lats) + pad_deg).alias("lat_max"),
        (F.array_min(lons) - pad_deg).alias("lon_min"),
        (F.array_max(lons) + pad_deg).alias("lon_max"),
    )


def region_id(lat, lon, level: int) -> Column:
    size = REGION_DEG[level]
    return F.struct(
        F.lit(level).alias("level"),
        big(F.floor(col(lon) / size)).alias("x"),
        big(F.floor(col(lat) / size)).alias("y"),
    )


def region_parent(region: Column) -> Column:
    """One level coarser, by floor division so negative cells nest correctly."""
    return F.struct(
        (region["level"] - 1).alias("level"),
        big(F.floor(region["x"] / 10)).alias("x"),
        big(F.floor(region["y"] / 10)).alias("y"),
    )


def region_neighbours(region: Column) -> Column:
    """The 3x3 block around a region, as an array of regions."""
    return F.array(
        *[
            F.struct(
                region["level"].alias("level"),
                (region["x"] + dx).alias("x"),
                (region["y"] + dy).alias("y"),
            )
            for dx in (-1, 0, 1)
            for dy in (-1, 0, 1)
        ]
    )


def region_topic(region: Column, prefix: str = "state") -> Column:
    return F.format_string(f"{prefix}-L%d-x%04d-y%04d", region["level"], region["x"], region["y"])


def subscribe_topics(region: Column, levels_up: bool = True) -> Column:
    """Sorted distinct topics of the 3x3 block at the own level and, above level 0, at the parent level."""
    own = F.transform(region_neighbours(region), lambda r: region_topic(r))
    if levels_up:
        own = F.concat(own, F.transform(region_neighbours(region_parent(region)), lambda r: region_topic(r)))
    return F.array_sort(F.array_distinct(own))


def cell_node(v, v_min, step, size) -> Column:
    """Node-centred raster index."""
    return big(clamp(F.round((col(v) - col(v_min)) / col(step)), 0.0, col(size).cast("double") - 1))


def cell_area(v, v_min, step, size) -> Column:
    """Area-centred raster index."""
    return big(clamp(F.round((col(v) - col(v_min)) / col(step) - 0.5), 0.0, col(size).cast("double") - 1))


def angle_lerp(a, b, t) -> Column:
    """Interpolate radians along the shorter arc."""
    a, b = col(a), col(b)
    delta = F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi
    return a + delta * col(t)
