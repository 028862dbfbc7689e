"""Map elements to features, features to tiles and chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import TILE_DEG, big, col, tile_key
from ..functions.geometry import (
    bbox_of_geometry, bbox_overlap, centroid_vertex_mean, in_bbox, is_closed, near_polyline_deg, point,
    point_in_polygon,
)
from ..session import cut_lineage
from .skew import salted_join, shuffled
from .spatial_join import CLASS

POINTS = "array<struct<lat:double,lon:double>>"
RING_SCHEMA = pa.schema([("relation_id", pa.int64()), ("ring", pa.int64()), ("geom", pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))])
CHUNK_MARGIN_DEG = 0.0003
#: Columns of the tiles under a feature's box: rows ``_s0.._s1`` and columns ``_w0.._w1``.
TILE_RANGE = ["_s0", "_s1", "_w0", "_w1"]


def gather_points(points: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Ordered points of each key as one geometry.  A geometry is one row, of the size the data model allows."""
    rows = points.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col("lat"), F.col("lon")))).alias("_p")
    )
    return rows.select(*keys, F.transform("_p", lambda p: point(p["lat"], p["lon"])).alias(out))


def way_geometry(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way node ids to coordinates in order; unknown nodes drop out and fewer than two points reject the way.

    Way nodes are shuffled once by node and once by way; adaptive execution splits the partition of a node many ways share.
    """
    found = way_nodes.join(shuffled(nodes.select("node_id", "lat", "lon")), "node_id")
    return gather_points(found, ["way_id"], "seq", "geom").where(F.size("geom") >= 2)


def way_tile_ranges(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id`` and the tiles under the box of each way of two points or more, without its geometry.

    The tile of a box's side is the outermost tile of the points, so points need neither order nor coordinates, and rows of
    three numbers go to their way.
    """
    at = nodes.select("node_id", tile_key("lat").alias("_s"), tile_key("lon").alias("_w"))
    found = way_nodes.select("way_id", "node_id").join(shuffled(at), "node_id")
    ends = [f(c).alias(n) for n, (f, c) in zip(TILE_RANGE, ((F.min, "_s"), (F.max, "_s"), (F.min, "_w"), (F.max, "_w")))]
    # Nodes of a way seldom meet before the shuffle, so rows that sum up a way's part would only be wider.
    boxes = found.select("way_id", "_s", "_w").repartition("way_id").groupBy("way_id").agg(F.count(F.lit(1)).alias("_n"), *ends)
    return boxes.where("_n >= 2").drop("_n")


def relation_rings(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Members of relations with geometry: ``relation_id, seq, role, geom`` for outer and inner roles."""
    members = relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("seq", "m")).select(
        "relation_id", big(F.col("seq")).alias("seq"), F.col("m.role").alias("role"), F.col("m.ref").alias("way_id")
    )
    return members.where(F.col("role").isin("outer", "inner")).join(shuffled(ways.select("way_id", "geom")), "way_id")


def stitch_ways(left: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings from ways in order, joined at equal ends."""
    rings = []
    while left:
        ring = left.pop(0)
        while ring and ring[0] != ring[-1]:
            hit = next((i for i, w in enumerate(left) if w and ring[-1] in (w[0], w[-1])), None)
            if hit is None:
                break
            way = left.pop(hit)
            ring = ring + (way if way[0] == ring[-1] else way[::-1])[1:]
        if len(ring) >= 3 and ring[0] != ring[-1]:
            ring.append(ring[0])
        if len(ring) >= 4:
            rings.append(ring)
    return rings


def ring_stitch(members: DataFrame) -> DataFrame:
    """Join outer ways of each relation into closed rings by equal endpoints: ``relation_id, ring, geom``.

    A relation is one small record of the map model, so one row holds one relation, and a call takes a batch of them.
    """

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"relation_id": [], "ring": [], "geom": []}
            for relation, ways in zip(batch["relation_id"].to_pylist(), batch["ways"].to_pylist()):
                rings = stitch_ways([[(p["lat"], p["lon"]) for p in w["geom"]] for w in ways])
                out["relation_id"] += [relation] * len(rings)
                out["ring"] += range(len(rings))
                out["geom"] += [[{"lat": a, "lon": b} for a, b in r] for r in rings]
            yield pa.RecordBatch.from_pydict(out, RING_SCHEMA)

    order = F.struct(F.col("seq").isNull().alias("last"), "seq", "geom")
    outer = members.where(F.col("role") == "outer").groupBy("relation_id").agg(F.sort_array(F.collect_list(order)).alias("ways"))
    return outer.mapInArrow(stitch, f"relation_id bigint, ring bigint, geom {POINTS}")


def chain_stitch(members: DataFrame) -> DataFrame:
    """Append outer ways in member order, flipping one when its far end is nearer to the chain's tail."""
    ordered = members.where(F.col("role") == "outer").groupBy("relation_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "geom"))).alias("_m")
    )

    def add(chain, m):
        way, tail = m["geom"], F.element_at(chain, -1)
        head, far = F.element_at(way, 1), F.element_at(way, -1)
        to_head = F.abs(tail["lat"] - head["lat"]) + F.abs(tail["lon"] - head["lon"])
        to_far = F.abs(tail["lat"] - far["lat"]) + F.abs(tail["lon"] - far["lon"])
        nxt = F.when(to_far < to_head, F.reverse(way)).otherwise(way)
        return F.concat(chain, F.slice(nxt, F.lit(2), F.size(nxt)))

    chain = F.aggregate(F.slice("_m", F.lit(2), F.size("_m")), F.element_at("_m", 1)["geom"], add)
    return ordered.select("relation_id", chain.alias("geom"))


def classify_ways(ways: DataFrame, profile: str = "import") -> DataFrame:
    """One row per (way, layer) for ``way_id, geom, tags``."""
    typed = ways.withColumn("closed", is_closed("geom") & (F.size("geom") > (2 if profile == "live" else 3)))
    typed = typed.withColumn("layer", F.explode(rules.way_layers("tags", "closed", profile)))
    return typed.withColumn("attrs", rules.way_attributes("tags", profile))


def classify_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("layer", F.explode(rules.node_layers("tags")))


def features_to_tiles(features: DataFrame, geom: str = "geom") -> DataFrame:
    """Replicate a feature to every 0.01 degree tile under its box."""
    return each_tile(_tile_range(features, geom))


def each_tile(ranges: DataFrame) -> DataFrame:
    """A row for every tile of the ranges ``TILE_RANGE``, in their place ``tile_s, tile_w``."""
    out = ranges.withColumn("tile_s", F.explode(F.sequence("_s0", "_s1")))
    return out.withColumn("tile_w", F.explode(F.sequence("_w0", "_w1"))).drop(*TILE_RANGE)


def _tile_range(features: DataFrame, geom: str) -> DataFrame:
    b = F.col("_box")
    ends = [tile_key(b[k]) for k in ("lat_min", "lat_max", "lon_min", "lon_max")]
    return features.withColumn("_box", bbox_of_geometry(geom)).select(*features.columns, *[e.alias(n) for e, n in zip(ends, TILE_RANGE)])


def in_clip(layer, geom, box: Column) -> Column:
    """Whether a feature survives a box: by vertex mean, any vertex, or any vertex or box overlap, by layer."""
    layer, g = col(layer), col(geom)
    vertex = F.exists(g, lambda p: in_bbox(p["lat"], p["lon"], box))
    mean = centroid_vertex_mean(g)
    area = vertex | bbox_overlap(bbox_of_geometry(g), box)
    closed_aeroway = (layer == "aeroways") & is_closed(g)
    return (
        F.when(layer == "buildings", in_bbox(mean["lat"], mean["lon"], box))
        .when(layer.isin("water", "waterway_lines", "parks", "land_areas") | closed_aeroway, area)
        .otherwise(vertex)
    )


def clip_features(features: DataFrame, lat_min, lat_max, lon_min, lon_max) -> DataFrame:
    box = F.struct(
        col(lat_min).alias("lat_min"), col(lat_max).alias("lat_max"),
        col(lon_min).alias("lon_min"), col(lon_max).alias("lon_max"),
    )
    return features.where(in_clip("layer", "geom", box))


def chunk_features(chunks: DataFrame, tiled: DataFrame) -> DataFrame:
    """Features of each chunk ``(chunk_id, lat_min, lat_max, lon_min, lon_max)``.

    All layers come from the tile of the chunk's centre; water and waterway lines also from the eight around it,
    each feature once.  ``tiled`` is the output of ``features_to_tiles`` with ``feature_id, layer, geom``.  Equal boxes
    are a class and so are equal features of a layer: classes are compared once, and their members joined on after.
    """
    m = CHUNK_MARGIN_DEG
    box = F.struct(
        (F.col("lat_min") - m).alias("lat_min"), (F.col("lat_max") + m).alias("lat_max"),
        (F.col("lon_min") - m).alias("lon_min"), (F.col("lon_max") + m).alias("lon_max"),
    )
    step = F.sequence(F.lit(-1), F.lit(1))
    corners, kind = ["lat_min", "lat_max", "lon_min", "lon_max"], ["layer", *CLASS]
    probes = (
        chunks.select(*corners).distinct()
        .withColumn("_box", box)
        .withColumn("_s", tile_key((F.col("lat_min") + F.col("lat_max")) * 0.5))
        .withColumn("_w", tile_key((F.col("lon_min") + F.col("lon_max")) * 0.5))
        .withColumn("_ds", F.explode(step))
        .withColumn("_dw", F.explode(step))
        .select(
            *corners, "_box",
            ((F.col("_ds") == 0) & (F.col("_dw") == 0)).alias("own"),
            (F.col("_s") + F.col("_ds")).alias("tile_s"), (F.col("_w") + F.col("_dw")).alias("tile_w"),
        )
    )
    classed = tiled.withColumn("_h1", F.xxhash64("geom")).withColumn("_h2", F.xxhash64(F.lit("again"), "geom"))
    one = classed.groupBy(*kind, "tile_s", "tile_w").agg(F.first("geom").alias("geom"))
    found = salted_join(one, probes, ["tile_s", "tile_w"], kind)
    flows = F.col("layer").isin("water", "waterway_lines")
    kept = found.where((F.col("own") | flows) & in_clip("layer", "geom", F.col("_box")))
    kept = cut_lineage(kept.select(*corners, *kind).distinct())
    rest = [F.first(c).alias(c) for c in classed.columns if c not in ("feature_id", "tile_s", "tile_w", *kind)]
    features = classed.groupBy("feature_id", *kind).agg(*rest)
    named = _unfolded(kept, features, kind, ["layer", "feature_id"], corners).drop(*CLASS)
    return _unfolded(named, chunks.select("chunk_id", *corners).distinct(), corners, ["chunk_id"], ["layer", "feature_id"]).drop(*corners)


def _unfolded(hits: DataFrame, members: DataFrame, keys: Sequence[str], ident: Sequence[str], rest: Sequence[str]) -> DataFrame:
    """``hits`` of classes (``keys``, ``rest``) with the members of each class in place of it, each pair once.

    A member (``ident``) is of one class but for rare ones, and only these can give a pair twice.  Few classes may give
    many pairs, so hits are dealt to a fixed number of tasks by both their sides.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = cut_lineage(members)
    rare = cut_lineage(members.groupBy(*ident).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*ident))
    dealt = hits.repartition(parts, *dict.fromkeys([*keys, *rest]))
    once = dealt.join(members.join(rare, list(ident), "left_anti"), list(keys))
    if rare.isEmpty():
        return once
    again = dealt.join(members.join(rare, list(ident), "left_semi"), list(keys))
    return once.unionByName(again.dropDuplicates(list(dict.fromkeys([*ident, *rest]))))


def _first_wet(lined: DataFrame, wet: DataFrame, max_steps: int | None) -> DataFrame:
    """The first wet tile of each chunk in both directions.  Rounds take twice the steps of the one before and only what
    has found nothing and can still meet the wet tiles' box."""
    pitch = TILE_DEG * 1.2
    ends = wet.agg(*[f(c) for c in ("tile_s", "tile_w") for f in (F.min, F.max)]).first()
    s0, s1, w0, w1 = (v if v is not None else 0 for v in ends)  # without water nothing is found, however far
    reach = [F.greatest(F.abs(F.col(v) - lo * TILE_DEG), F.abs(F.lit((hi + 1) * TILE_DEG) - F.col(v))) for v, lo, hi in (("lat", s0, s1), ("lon", w0, w1))]
    far = F.ceil(F.sqrt(reach[0] * reach[0] + reach[1] * reach[1]) / pitch)
    left = lined.withColumn("_far", far if max_steps is None else F.least(far, F.lit(max_steps)))
    left = cut_lineage(left.select(*lined.columns, "_far", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")))
    found, low, many = None, 1, 8
    while True:
        steps = (
            left.where(F.col("_far") >= low).withColumn("step", F.explode(F.sequence(F.lit(low).cast("bigint"), F.least(F.col("_far"), F.lit(low + many - 1).cast("bigint")))))
            .withColumn("_off", F.col("step") * pitch * F.col("side"))
            .withColumn("tile_s", tile_key(F.col("lat") + F.col("ux") * F.col("_off")))
            .withColumn("tile_w", tile_key(F.col("lon") + F.col("uy") * F.col("_off")))
            .where((F.col("tile_s") != tile_key("lat")) | (F.col("tile_w") != tile_key("lon")))
        )
        near = cut_lineage(
            steps.join(wet, ["tile_s", "tile_w"], "left_semi").groupBy("chunk_id", "side")
            .agg(F.min_by(F.struct("tile_s", "tile_w", "lat", "lon", "ux", "uy"), "step").alias("_f")).select("chunk_id", "side", "_f.*")
        )
        found = near if found is None else found.unionByName(near)
        low, many = low + many, 2 * many
        left = cut_lineage(left.where(F.col("_far") >= low).join(near.select("chunk_id", "side"), ["chunk_id", "side"], "left_anti"))
        if left.isEmpty():
            return found


def gap_bridge(chunks: DataFrame, water_tiled: DataFrame, max_steps: int | None = None) -> DataFrame:
    """Quad joining the water before and after a chunk along its centreline.

    ``chunks``: chunk_id, lat, lon (centre), first_lat, first_lon, last_lat, last_lon of its lines.
    ``water_tiled``: water features by tile with ``geom``.  The first tile with water in each direction counts, however
    far, or within ``max_steps`` steps of 1.2 tiles.
    """
    dlat, dlon = F.col("last_lat") - F.col("first_lat"), F.col("last_lon") - F.col("first_lon")
    length = F.sqrt(dlat * dlat + dlon * dlon)
    lined = chunks.withColumn("_len", length).where(F.col("_len") >= 1e-10)
    lined = lined.select("chunk_id", "lat", "lon", (dlat / F.col("_len")).alias("ux"), (dlon / F.col("_len")).alias("uy"))
    first = _first_wet(lined, water_tiled.select("tile_s", "tile_w").distinct(), max_steps)
    verts = water_tiled.select("tile_s", "tile_w", F.explode("geom").alias("p"))
    along = F.col("p.lat") * F.col("ux") + F.col("p.lon") * F.col("uy")
    across = F.col("p.lon") * F.col("ux") - F.col("p.lat") * F.col("uy")
    centre = F.col("lat") * F.col("ux") + F.col("lon") * F.col("uy")
    pts = first.join(verts, ["tile_s", "tile_w"]).withColumn("_d", F.abs(along - centre)).withColumn("_x", across)
    nearest = pts.groupBy("chunk_id", "side").agg(F.min("_d").alias("_min"))
    ends = (
        pts.join(nearest, ["chunk_id", "side"])
        .where(F.col("_d") <= F.col("_min") + TILE_DEG)
        .groupBy("chunk_id", "side")
        .agg(F.max_by("p", "_x").alias("left"), F.min_by("p", "_x").alias("right"))
    )
    up, down = ends.where("side = -1"), ends.where("side = 1")
    return up.select("chunk_id", F.col("left").alias("la"), F.col("right").alias("ra")).join(
        down.select("chunk_id", F.col("left").alias("lb"), F.col("right").alias("rb")), "chunk_id"
    ).select("chunk_id", F.array("la", "ra", "rb", "lb").alias("quad"))


def tile_probe(probes: DataFrame, tiled: DataFrame) -> DataFrame:
    """Hits of labelled points against the lines (0.002 degrees) and polygons of their own tile."""
    keyed = probes.withColumn("tile_s", tile_key("lat")).withColumn("tile_w", tile_key("lon"))
    hit = F.when(F.col("layer") == "water", point_in_polygon("lat", "lon", "geom")).otherwise(
        near_polyline_deg("lat", "lon", "geom")
    )
    return salted_join(keyed, tiled, ["tile_s", "tile_w"], ["probe_id"]).where(hit).drop("tile_s", "tile_w", "geom")


def bbox_features(features: DataFrame, geom: str = "geom") -> DataFrame:
    """Features per layer and tile under their boxes.

    A box adds one at two of its corners and takes one away past the others; sums along rows and then along columns of
    tiles give the counts.  Rows grow with features and with tiles that hold any, not with the tiles of all features.
    """
    s0, s1, w0, w1 = (F.col(c) for c in TILE_RANGE)
    corner = [F.struct(s.alias("_s"), w.alias("_w"), F.lit(d).cast("bigint").alias("_d")) for s, w, d in ((s0, w0, 1), (s0, w1 + 1, -1), (s1 + 1, w0, -1), (s1 + 1, w1 + 1, 1))]
    ranges = _tile_range(features, geom).where(s0.isNotNull() & w0.isNotNull())
    steps = ranges.select("layer", F.inline(F.array(*corner))).groupBy("layer", "_s", "_w").agg(F.sum("_d").alias("_d"))

    def summed(df, line, at, out):
        """Running sums ``_d`` along ``at`` in each ``line``, a row for every tile where they are not zero."""
        w = Window.partitionBy("layer", line).orderBy(at)
        df = df.withColumn("_n", F.sum("_d").over(w)).withColumn("_to", F.lead(at).over(w) - 1).where("_n <> 0")
        return df.select("layer", line, F.col("_n").alias("_d"), F.explode(F.sequence(at, "_to")).alias(out))

    rows = summed(steps, "_s", "_w", "tile_w")
    return summed(rows, "tile_w", "_s", "tile_s").select("layer", "tile_s", "tile_w", F.col("_d").alias("n"))
