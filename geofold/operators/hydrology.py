"""Water on columns: flat water bodies, channels, banks and the runs they replace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import CHUNK_X, CHUNK_Z, big, clamp, col
from ..functions.geometry import lerp_at
from ..session import cut_lineage
from .columns import COLUMN
from .raster import D8_NAMES, dilate_mask, neighbours
from .skew import shuffled
from .spatial_join import CLASS, explode_segments, nearest_segment, points_in_classes, points_inside, polygon_classes

# Fixed values.
WATER_DEPTH = 5
MAX_CARVE = 15
FLOW_STEP = 1
BANK_STEP = 2
MAX_GAP = 3
MAX_OVERBURDEN = 4
SEARCH_M = 300.0
CHANNEL_BED = 200
CHUNK = ["cx", "cz"]


def backbone_points(lines: DataFrame) -> DataFrame:
    """Start and middle of each segment of channel lines: ``line_id, lat, lon, k``."""
    s = explode_segments(lines)
    a, b = F.col("a"), F.col("b")
    mid = F.struct(((a["lat"] + b["lat"]) * 0.5).alias("lat"), ((a["lon"] + b["lon"]) * 0.5).alias("lon"))
    pts = s.select("line_id", "seg", F.posexplode(F.array(a, mid)).alias("k", "p"))
    return pts.select("line_id", "seg", "k", "p.lat", "p.lon")


def channel_backing(water: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (poly_id, line_id) of channel water and channel lines running inside it.

    ``water``: poly_id, water_type, polygon.  ``lines``: line_id, waterway, line.
    """
    w, pts = _channel_classes(water), _channel_points(lines)
    met = points_in_classes(pts, w, ["line_id", "seg", "k"]).select("line_id", *CLASS).distinct()
    return met.join(shuffled(w), CLASS).select("poly_id", "line_id").distinct()


def _channel_classes(water: DataFrame) -> DataFrame:
    return polygon_classes(water.where(F.col("water_type").isin(*rules.CHANNEL_TYPES)).select("poly_id", "polygon"))


def _channel_points(lines: DataFrame) -> DataFrame:
    return backbone_points(lines.where(F.col("waterway").isin(*rules.CHANNEL_TYPES)))


def backed_polygons(water: DataFrame, lines: DataFrame) -> DataFrame:
    """``poly_id`` of channel water with a channel line inside, by places and classes: no pair of ids is formed."""
    w = _channel_classes(water)
    met = points_in_classes(_channel_points(lines).select("lat", "lon").distinct(), w, ["lat", "lon"]).select(*CLASS).distinct()
    return w.join(shuffled(met), CLASS, "left_semi").select("poly_id").distinct()


def backing_lines(water: DataFrame, lines: DataFrame) -> DataFrame:
    """``line_id`` of channel lines that run inside channel water."""
    w = water.where(F.col("water_type").isin(*rules.CHANNEL_TYPES)).select("poly_id", "polygon")
    return points_inside(_channel_points(lines), w, ["line_id", "seg", "k"]).select("line_id").distinct()


def water_polygon_fill(columns: DataFrame, water: DataFrame, lines: DataFrame) -> DataFrame:
    """Water level of flat water per column: ``cx, cz, vx, vz, level_y, terrain_y``.

    ``columns``: cx, cz, vx, vz, lat, lon, terrain_y.  Channel polygons with a centreline inside are left to the
    channel pass.  The level of a chunk is its lowest wet column, but no more than 15 below any; columns more than 15
    above the level stay dry.
    """
    flat = cut_lineage(water.join(backed_polygons(water, lines), "poly_id", "left_anti"))
    wet = points_inside(columns.select(*COLUMN, "terrain_y", "lat", "lon"), flat, COLUMN, holes="holes").select(*COLUMN, "terrain_y").distinct()
    wet = cut_lineage(wet)  # the level, the columns and what paints them read it several times
    level = wet.groupBy(*CHUNK).agg(
        F.greatest(F.min("terrain_y"), F.max(F.col("terrain_y") - MAX_CARVE)).alias("level_y")
    )
    return wet.join(level, CHUNK).where(F.col("terrain_y") <= F.col("level_y") + MAX_CARVE)


def water_runs(filled: DataFrame) -> DataFrame:
    """Changes for flat water: two stone, water up to the level, air below the old surface."""
    level, top = F.col("level_y"), F.col("terrain_y")
    changes = F.array(
        _run(level - WATER_DEPTH - 2, level - WATER_DEPTH - 1, "STONE", 1),
        _run(level + 1, top - 1, "AIR", 1),
        _run(level - WATER_DEPTH, level, "WATER", 2),
    )
    return _explode(filled, changes)


def _run(y0, y1, material, order) -> Column:
    m = F.lit(material) if isinstance(material, str) else material
    return F.struct(big(y0).alias("y0"), big(y1).alias("y1"), m.alias("material"), F.lit(order).alias("ord"))


def _explode(df: DataFrame, changes: Column) -> DataFrame:
    out = df.select(*COLUMN, F.explode(changes).alias("_r")).where(F.col("_r").isNotNull()).select(*COLUMN, "_r.*")
    return out.where(F.col("y1") >= F.col("y0"))


def channel_profile(columns: DataFrame, rivers: DataFrame, lines: DataFrame, water: DataFrame) -> DataFrame:
    """Water surface and carve depth for columns near channels.

    ``rivers``: line_id, line, and arrays water_m, half_width_m, depth_m per vertex.  ``lines``: line_id, waterway,
    line, elev (array).  The nearest river within 300 m counts, else the nearest line.  Columns are kept when inside
    a backed channel polygon or within the half width plus the bank zone.
    """
    backed_lines = backing_lines(water, lines).withColumn("polygon_backed", F.lit(True))
    backed_water = water.join(backed_polygons(water, lines), "poly_id", "left_semi")
    pts = columns.select(*COLUMN, "lat", "lon")

    def nearest(src):
        segs = explode_segments(src.select("line_id", "line"))
        return nearest_segment(pts, segs, COLUMN, ["line_id", "seg"], SEARCH_M, SEARCH_M, inclusive=False, carry=["n_seg"])

    river = nearest(rivers).join(rivers.select("line_id", "water_m", "half_width_m", "depth_m"), "line_id")
    at = (F.col("seg") + F.col("t")) / F.greatest(F.col("n_seg"), F.lit(1))
    river = cut_lineage(river).select(
        *COLUMN, "line_id", "dist_m", lerp_at("water_m", at).alias("water_m"),
        lerp_at("half_width_m", at).alias("half_width_m"), lerp_at("depth_m", at).alias("depth_m"),
    )
    plain = nearest(lines).join(lines.select("line_id", "waterway", "elev"), "line_id").join(river.select(*COLUMN), COLUMN, "left_anti")
    d = rules.waterway_defaults("waterway")
    e0, e1 = F.element_at("elev", (F.col("seg") + 1).cast("int")), F.element_at("elev", (F.col("seg") + 2).cast("int"))
    plain = plain.select(
        *COLUMN, "line_id", "dist_m", (e0 + (e1 - e0) * F.col("t")).alias("water_m"),
        d["half_width_m"].alias("half_width_m"), d["depth_vox"].cast("double").alias("depth_m"),
    )
    p = river.unionByName(plain).withColumn("half_width_m", F.greatest("half_width_m", F.lit(1.0)))
    bank = clamp(F.col("dist_m") / F.col("half_width_m"), 0.0, 1.0)
    p = p.withColumn("carve_m", F.greatest(F.col("depth_m") * (F.lit(1.0) - bank * bank), F.lit(0.0)))
    p = p.withColumn("center_depth_m", F.greatest("depth_m", F.lit(1.0))).drop("depth_m")
    inside = points_inside(pts, backed_water, COLUMN, holes="holes").select(*COLUMN).distinct().withColumn("inside_polygon", F.lit(True))
    p = p.join(backed_lines, "line_id", "left").join(inside, COLUMN, "left")
    p = p.withColumn("polygon_backed", F.coalesce("polygon_backed", F.lit(False))).withColumn("inside_polygon", F.coalesce("inside_polygon", F.lit(False)))
    reach = F.col("half_width_m") + rules.bank_zone_width_m("half_width_m", "center_depth_m")
    p = p.where(F.col("inside_polygon") | (F.col("dist_m") <= reach))
    wetted = F.when(F.col("dist_m") <= F.col("half_width_m"), big(F.round(F.greatest("carve_m", F.lit(1.0)))))
    return p.withColumn("wetted", wetted).join(columns.select(*COLUMN, "terrain_y"), COLUMN)


def _local(df: DataFrame) -> DataFrame:
    return df.withColumn("r", F.col("vz") - F.col("cz") * CHUNK_Z).withColumn("c", F.col("vx") - F.col("cx") * CHUNK_X)


def _around(df: DataFrame, value: str) -> tuple[DataFrame, Column, Column, Column]:
    """Neighbours of ``value`` inside the chunk; with their minimum, maximum and count."""
    near = neighbours(_local(df), value, CHUNK, block=32)
    cols = [F.col(f"{value}_{d}") for d in D8_NAMES]
    count = None
    for c in cols:
        one = F.when(c.isNotNull(), 1).otherwise(0)
        count = one if count is None else count + one
    return near, F.least(*cols), F.greatest(*cols), count


def channel_stabilise(columns: DataFrame, value: str = "water_y") -> DataFrame:
    """Clamp each water surface to its neighbours' range widened by one; needs two neighbours."""
    near, low, high, count = _around(columns, value)
    fixed = F.when(count >= 2, F.least(F.greatest(F.col(value), low - FLOW_STEP), high + FLOW_STEP)).otherwise(F.col(value))
    return near.withColumn(value, fixed).select(*columns.columns)


def bank_stabilise(columns: DataFrame) -> DataFrame:
    """Clamp bank tops ``bank_y`` to the anchors around them widened by two, then between water and terrain.

    ``columns``: bank_y (null on wet columns), water_y, terrain_y, wet.
    """
    anchor = F.coalesce("bank_y", F.when(F.col("wet"), F.least(F.col("water_y") + 1, F.col("terrain_y"))))
    near, low, high, count = _around(columns.withColumn("_a", anchor), "_a")
    floor = F.coalesce(F.least(F.col("water_y") + 1, F.col("terrain_y")), F.col("terrain_y"))
    fixed = F.least(F.greatest(F.least(F.greatest(F.col("bank_y"), low - BANK_STEP), high + BANK_STEP), floor), F.col("terrain_y"))
    return near.withColumn("bank_y", F.when(F.col("bank_y").isNotNull() & (count >= 2), fixed).otherwise(F.col("bank_y"))).select(*columns.columns)


def channel_wetting(wetted, polygon_backed, inside, mask) -> Column:
    """Wetted depth under the polygon rules; null is dry."""
    w = col(wetted)
    return (
        F.when(col(inside), F.when(col(mask), F.coalesce(w, F.lit(1))))
        .when(col(polygon_backed) & ~col(mask), F.lit(None))
        .otherwise(w)
    ).cast("bigint")


def bank_taper(terrain_y, water_y, dist_m, half_width_m, center_depth_m) -> Column:
    """Bank top between water and terrain by a smooth step over the bank zone; null outside it."""
    ty, wy = col(terrain_y), col(water_y)
    zone = rules.bank_zone_width_m(half_width_m, center_depth_m)
    away = F.greatest(col(dist_m) - col(half_width_m), F.lit(0.0))
    t = clamp(away / zone, 0.0, 1.0)
    rise = big(F.round((ty - wy) * (t * t * (F.lit(3.0) - t * 2.0))))
    top = F.least(F.greatest(wy + rise, F.least(wy + 1, ty)), ty)
    return F.when((ty > wy) & (away < zone), top).cast("bigint")


# Axes as (negative direction, positive direction); the first of equal bridges wins.
AXES = [((-1, 0), (1, 0)), ((0, -1), (0, 1)), ((-1, -1), (1, 1)), ((-1, 1), (1, -1))]


def channel_bridge(columns: DataFrame) -> DataFrame:
    """Close gaps of up to three dry columns between wet ones on four axes; reads one snapshot.

    ``columns``: every column of the chunks with terrain_y and mask, and on channel columns water_y, wetted,
    half_width_m, center_depth_m, dist_m, polygon_backed, inside_polygon.  Returns them with bridged columns filled in.
    """
    local = _local(columns).withColumn(
        "wet_now", channel_wetting("wetted", F.coalesce("polygon_backed", F.lit(False)), F.coalesce("inside_polygon", F.lit(False)), "mask")
    )
    is_wet = F.col("wet_now").isNotNull() & F.col("water_y").isNotNull()
    dirs = [d for pair in AXES for d in pair]
    anchor = F.struct("water_y", F.greatest(F.coalesce("wetted", F.lit(1)), F.lit(1)).alias("depth"), "half_width_m", "center_depth_m", "polygon_backed")
    moves = F.array(*[F.struct(F.lit(i).alias("dir"), F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for i, (dx, dz) in enumerate(dirs)])
    # A wet column is seen from the columns that lie against the direction.
    seen = (
        local.where(is_wet).select(*CHUNK, "r", "c", anchor.alias("a"))
        .withColumn("m", F.explode(moves))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(MAX_GAP + 1))))
        .select(*CHUNK, (F.col("r") - F.col("m.dz") * F.col("step")).alias("r"), (F.col("c") - F.col("m.dx") * F.col("step")).alias("c"), "m.dir", "step", "a")
    )
    first = seen.groupBy(*CHUNK, "r", "c").agg(
        *[F.min_by(F.struct("step", "a"), F.when(F.col("dir") == i, F.col("step"))).alias(f"d{i}") for i in range(8)]
    )
    dry = local.join(first, [*CHUNK, "r", "c"], "left")
    best = None
    for axis in range(4):
        n, p = F.col(f"d{2 * axis}"), F.col(f"d{2 * axis + 1}")
        gap, span = n["step"] + p["step"] - 1, n["step"] + p["step"]
        delta = F.abs(p["a"]["water_y"] - n["a"]["water_y"])
        backed = F.coalesce("polygon_backed", n["a"]["polygon_backed"] | p["a"]["polygon_backed"])

        def mix(field, whole):
            a, b = n["a"][field], p["a"][field]
            v = a + (b - a) * (n["step"] / span)
            return big(F.round(v)) if whole else v

        water = F.coalesce("water_y", mix("water_y", True))
        depth = F.greatest(mix("depth", True), F.lit(1))
        ok = (
            n.isNotNull() & p.isNotNull() & (gap <= MAX_GAP) & (delta <= (gap + 1) * FLOW_STEP) & (~backed | F.col("mask"))
            & (F.col("terrain_y") <= water + F.greatest(F.lit(MAX_OVERBURDEN), depth + 1))
        )
        cand = F.when(
            ok,
            F.struct(
                big(gap).alias("gap"), big(delta).alias("delta"), F.lit(axis).alias("axis"), water.alias("water_y"), depth.alias("wetted"),
                F.greatest(F.coalesce("half_width_m", mix("half_width_m", False)), F.lit(1.0)).alias("half_width_m"),
                F.greatest(F.coalesce("center_depth_m", mix("center_depth_m", False)), F.lit(1.0)).alias("center_depth_m"),
                F.coalesce("dist_m", F.lit(0.0)).alias("dist_m"), backed.alias("polygon_backed"),
            ),
        )
        best = [cand] if best is None else best + [cand]
    choice = F.array_min(F.filter(F.array(*best), lambda x: x.isNotNull()))
    out = dry.withColumn("_b", F.when(~is_wet, choice))
    fill = F.col("_b").isNotNull()
    for f in ("water_y", "wetted", "half_width_m", "center_depth_m", "dist_m", "polygon_backed"):
        out = out.withColumn(f, F.when(fill, F.col(f"_b.{f}")).otherwise(F.col(f)))
    return out.withColumn("bridged", fill).select(*columns.columns, "bridged")


def channel_pass(columns: DataFrame, profile: DataFrame, origin_alt: float, origin_vy: int) -> DataFrame:
    """Water and bank heights of all channel columns, from ``channel_profile``.

    Surfaces come from the profile's height when above one metre, else from the terrain; they are
    smoothed, gaps bridged, smoothed again, wetted within the widened polygons, and banks tapered and smoothed.
    """
    prof = profile.join(columns.select(*COLUMN, "lat", "lon"), COLUMN)
    ortho = rules.ortho_to_voxel_y("water_m", "lat", "lon", F.lit(origin_alt), F.lit(origin_vy))
    surface = F.when(F.col("water_m") > 1.0, ortho).otherwise(F.col("terrain_y"))
    prof = cut_lineage(prof.withColumn("water_y", big(surface)))
    chan = ["line_id", "water_y", "wetted", "half_width_m", "center_depth_m", "dist_m", "polygon_backed", "inside_polygon"]
    steady = channel_stabilise(prof.select(*COLUMN, "terrain_y", *chan))
    active = columns.join(prof.select(*CHUNK).distinct(), CHUNK, "left_semi").select(*COLUMN, "terrain_y")
    everything = active.join(steady.select(*COLUMN, *chan), COLUMN, "left")
    masked = dilate_mask(_local(everything).withColumn("inside_polygon", F.coalesce("inside_polygon", F.lit(False))), "inside_polygon", 1, CHUNK, "mask")
    bridged = cut_lineage(channel_bridge(cut_lineage(masked.drop("r", "c")))).where(F.col("water_y").isNotNull())
    again = channel_stabilise(bridged)
    wet = channel_wetting("wetted", F.coalesce("polygon_backed", F.lit(False)), "inside_polygon", "mask")
    out = again.withColumn("wetted", wet).withColumn("wet", F.col("wetted").isNotNull())
    out = out.withColumn("bank_y", F.when(~F.col("wet"), bank_taper("terrain_y", "water_y", "dist_m", "half_width_m", "center_depth_m")))
    return bank_stabilise(out.select(*COLUMN, "terrain_y", "water_y", "wetted", "wet", "bank_y"))


def hydro_runs(channel: DataFrame) -> DataFrame:
    """Changes for channel columns: bed, water and cleared air on wet ones, cleared air above banks."""
    wy, depth, ty = F.col("water_y"), F.greatest("wetted", F.lit(1)), F.col("terrain_y")
    wet = F.array(_run(wy - CHANNEL_BED, wy - depth - 1, "STONE", 1), _run(wy - depth, wy, "WATER", 2), _run(wy + 1, ty, "AIR", 2))
    bank = F.array(_run(F.col("bank_y") + 1, ty, "AIR", 2))
    empty = F.array().cast("array<struct<y0:bigint,y1:bigint,material:string,ord:int>>")
    return _explode(channel, F.when(F.col("wet"), wet).when(F.col("bank_y").isNotNull(), bank).otherwise(empty))
