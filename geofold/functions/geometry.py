"""Planar geometry on ``array<struct<lat,lon>>`` columns, as native expressions.

Degrees are treated as a plane, as the inputs are small; the metre functions use a local flat projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import M_PER_DEG, TILE_DEG, big, clamp, col, flat_scale_lon

# Fixed values.
COLLINEAR_EPS = 1.0e-12
WATERWAY_HALF_WIDTH_DEG = 0.002


def point(lat, lon) -> Column:
    return F.struct(col(lat).cast("double").alias("lat"), col(lon).cast("double").alias("lon"))


def segments(geom) -> Column:
    """Consecutive point pairs; empty for fewer than two points."""
    g = col(geom)
    n = F.size(g)
    return F.when(
        n >= 2,
        F.zip_with(
            F.slice(g, F.lit(1), n - 1), F.slice(g, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        ),
    ).otherwise(F.array().cast("array<struct<a:struct<lat:double,lon:double>,b:struct<lat:double,lon:double>>>"))


def ring_edges(geom) -> Column:
    """Edges of a ring including the closing one (zero length when the first point is repeated)."""
    g = col(geom)
    n = F.size(g)
    return F.when(
        n >= 2,
        F.zip_with(
            g,
            F.concat(F.slice(g, F.lit(2), n - 1), F.slice(g, F.lit(1), F.lit(1))),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        ),
    ).otherwise(F.array().cast("array<struct<a:struct<lat:double,lon:double>,b:struct<lat:double,lon:double>>>"))


def edges_contain(lat, lon, edges) -> Column:
    """Even-odd rule on ring edges: an odd number of them cross the ray from the point."""
    lat, lon = col(lat), col(lon)

    def crosses(e):
        a, b = e["a"], e["b"]
        span = F.nullif(b["lon"] - a["lon"], F.lit(0.0))
        at = (b["lat"] - a["lat"]) * (lon - a["lon"]) / span + a["lat"]
        return ((a["lon"] > lon) != (b["lon"] > lon)) & (lat < at)

    return F.size(F.filter(col(edges), crosses)) % 2 == 1


def point_in_polygon(lat, lon, polygon) -> Column:
    """Whether a point is inside a ring; fewer than three points hold nothing."""
    return (F.size(col(polygon)) >= 3) & edges_contain(lat, lon, ring_edges(polygon))


def point_in_water(lat, lon, polygon, holes) -> Column:
    return point_in_polygon(lat, lon, polygon) & ~F.exists(col(holes), lambda h: point_in_polygon(lat, lon, h))


def lon_scale(lat) -> Column:
    """Metres per degree of longitude."""
    return F.cos(F.radians(col(lat))) * M_PER_DEG


def segment_hit(lat, lon, a: Column, b: Column, floor_cos: bool = False, scale: Column | None = None) -> Column:
    """Distance in metres, fraction along the segment and closest point, in a flat frame at the point.

    ``scale`` is the point's ``lon_scale`` when it is at hand.
    """
    lat, lon = col(lat), col(lon)
    sz = scale if scale is not None else flat_scale_lon(lat) if floor_cos else lon_scale(lat)
    px, pz = (lat - a["lat"]) * M_PER_DEG, (lon - a["lon"]) * sz
    dx, dz = (b["lat"] - a["lat"]) * M_PER_DEG, (b["lon"] - a["lon"]) * sz
    len2 = dx * dx + dz * dz
    t = F.when(len2 < 1e-10, F.lit(0.0)).otherwise(
        clamp((px * dx + pz * dz) / F.greatest(len2, F.lit(1e-300)), 0.0, 1.0)
    )
    cx, cz = dx * t - px, dz * t - pz
    return F.struct(
        F.sqrt(cx * cx + cz * cz).alias("dist_m"),
        t.alias("t"),
        (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"),
        (a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"),
    )


def point_segment_distance_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    return segment_hit(lat, lon, point(lat1, lon1), point(lat2, lon2))


def point_polyline_distance_m(lat, lon, line) -> Column:
    """Null for fewer than two points."""
    return F.array_min(
        F.transform(segments(line), lambda s: segment_hit(lat, lon, s["a"], s["b"], floor_cos=True)["dist_m"])
    )


def near_polyline_deg(lat, lon, line, half_width_deg=WATERWAY_HALF_WIDTH_DEG) -> Column:
    lat, lon = col(lat), col(lon)

    def near(s):
        a, b = s["a"], s["b"]
        dx, dy = b["lat"] - a["lat"], b["lon"] - a["lon"]
        len2 = dx * dx + dy * dy
        t = F.when(len2 < 1e-14, F.lit(0.0)).otherwise(
            clamp(((lat - a["lat"]) * dx + (lon - a["lon"]) * dy) / F.greatest(len2, F.lit(1e-300)), 0.0, 1.0)
        )
        ex, ey = a["lat"] + t * dx - lat, a["lon"] + t * dy - lon
        return ex * ex + ey * ey <= col(half_width_deg) * col(half_width_deg)

    return F.exists(segments(line), near)


def bbox_of_geometry(geom) -> Column:
    lats = F.transform(col(geom), lambda p: p["lat"])
    lons = F.transform(col(geom), lambda p: p["lon"])
    return F.struct(
        F.array_min(lats).alias("lat_min"),
        F.array_max(lats).alias("lat_max"),
        F.array_min(lons).alias("lon_min"),
        F.array_max(lons).alias("lon_max"),
    )


def bbox_overlap(a: Column, b: Column) -> Column:
    """Closed-interval overlap."""
    return (
        (a["lat_max"] >= b["lat_min"])
        & (a["lat_min"] <= b["lat_max"])
        & (a["lon_max"] >= b["lon_min"])
        & (a["lon_min"] <= b["lon_max"])
    )


def in_bbox(lat, lon, box: Column) -> Column:
    return col(lat).between(box["lat_min"], box["lat_max"]) & col(lon).between(box["lon_min"], box["lon_max"])


def centroid_vertex_mean(geom) -> Column:
    def mean(field):
        return F.aggregate(col(geom), F.lit(0.0), lambda acc, p: acc + p[field]) / F.size(col(geom))

    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def tile_range(box: Column) -> Column:
    """All 0.01 degree tiles under a box, as an array of (s, w)."""
    rows = F.sequence(big(F.floor(box["lat_min"] / TILE_DEG)), big(F.floor(box["lat_max"] / TILE_DEG)))
    cols = F.sequence(big(F.floor(box["lon_min"] / TILE_DEG)), big(F.floor(box["lon_max"] / TILE_DEG)))
    return F.flatten(
        F.transform(rows, lambda s: F.transform(cols, lambda w: F.struct(s.alias("s"), w.alias("w"))))
    )


def tile_keys_of_bbox(geom) -> Column:
    return tile_range(bbox_of_geometry(geom))


def _orient(a: Column, b: Column, c: Column) -> Column:
    return (b["lon"] - a["lon"]) * (c["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (c["lon"] - a["lon"])


def _on_segment(a: Column, b: Column, p: Column) -> Column:
    eps = COLLINEAR_EPS
    return (
        (p["lon"] >= F.least(a["lon"], b["lon"]) - eps)
        & (p["lon"] <= F.greatest(a["lon"], b["lon"]) + eps)
        & (p["lat"] >= F.least(a["lat"], b["lat"]) - eps)
        & (p["lat"] <= F.greatest(a["lat"], b["lat"]) + eps)
    )


def segments_intersect(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Proper crossing, or an endpoint lying on the other segment within the tolerance."""
    eps = COLLINEAR_EPS
    o1, o2 = _orient(a0, a1, b0), _orient(a0, a1, b1)
    o3, o4 = _orient(b0, b1, a0), _orient(b0, b1, a1)

    def split(p, q):
        return ((p > eps) & (q < -eps)) | ((p < -eps) & (q > eps))

    return (
        (split(o1, o2) & split(o3, o4))
        | ((F.abs(o1) <= eps) & _on_segment(a0, a1, b0))
        | ((F.abs(o2) <= eps) & _on_segment(a0, a1, b1))
        | ((F.abs(o3) <= eps) & _on_segment(b0, b1, a0))
        | ((F.abs(o4) <= eps) & _on_segment(b0, b1, a1))
    )


def polygon_hits_cell(polygon, box: Column, edges: Column | None = None) -> Column:
    """Cell centre or a corner inside, a vertex in the cell, or a ring edge crossing a cell side.

    ``edges`` are the polygon's ``ring_edges`` when they are at hand.
    """
    poly = col(polygon)
    edges = ring_edges(poly) if edges is None else edges
    lat0, lat1, lon0, lon1 = box["lat_min"], box["lat_max"], box["lon_min"], box["lon_max"]
    corners = [point(lat0, lon0), point(lat0, lon1), point(lat1, lon1), point(lat1, lon0)]
    sides = list(zip(corners, corners[1:] + corners[:1]))
    inside = edges_contain((lat0 + lat1) * 0.5, (lon0 + lon1) * 0.5, edges)
    inside = inside | F.exists(poly, lambda p: in_bbox(p["lat"], p["lon"], box))
    for c in corners:
        inside = inside | edges_contain(c["lat"], c["lon"], edges)

    def edge_hits(e):
        hit = segments_intersect(e["a"], e["b"], *sides[0])
        for side in sides[1:]:
            hit = hit | segments_intersect(e["a"], e["b"], *side)
        return hit

    return (F.size(poly) >= 3) & (inside | F.exists(edges, edge_hits))


def polygons_intersect(a, b) -> Column:
    """Boxes overlap and either ring has a vertex in the other, or drawn edges cross.

    The closing edge counts only when the ring repeats its first point.
    """
    a, b = col(a), col(b)
    return (
        (F.size(a) >= 3)
        & (F.size(b) >= 3)
        & bbox_overlap(bbox_of_geometry(a), bbox_of_geometry(b))
        & (
            F.exists(a, lambda p: point_in_polygon(p["lat"], p["lon"], b))
            | F.exists(b, lambda p: point_in_polygon(p["lat"], p["lon"], a))
            | F.exists(
                segments(a),
                lambda s: F.exists(segments(b), lambda t: segments_intersect(s["a"], s["b"], t["a"], t["b"])),
            )
        )
    )


def lerp_at(values, t) -> Column:
    """Linear interpolation of an array at a global fraction in 0..1."""
    v, n = col(values), F.size(col(values)) - 1
    pos = clamp(col(t) * n, 0.0, n.cast("double"))
    lo = F.floor(pos).cast("int")
    a, b = F.element_at(v, lo + 1), F.element_at(v, F.least(lo + 1, n) + 1)
    return a + (b - a) * (pos - lo)


def polyline_at_t(surface, half_width, depth, t) -> Column:
    return F.struct(
        lerp_at(surface, t).alias("water_surface_m"),
        lerp_at(half_width, t).alias("half_width_m"),
        lerp_at(depth, t).alias("depth_m"),
    )


def is_closed(geom) -> Column:
    g = col(geom)
    return (F.size(g) >= 3) & (F.element_at(g, 1) == F.element_at(g, -1))
