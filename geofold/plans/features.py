"""Queries for map features: geometry, classification, tiles, clips and joins with features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as gm, rules
from ..functions.geo import big
from ..operators import features as ft, spatial_join as sj
from .catalog import query
from .scalars import BOX_SQL, EDGE_SQL, SEG_SQL, dist_t_sql, inside_sql, way_tags

WAY_PTS = "(select w.way_id, w.seq, n.lat, n.lon from way_node w join node n on n.node_id=w.node_id)"
WAY_BOX = f"(select way_id, count(*) n, min(lat) lat0, max(lat) lat1, min(lon) lon0, max(lon) lon1 from {WAY_PTS} p group by way_id having count(*)>=2)"
TILES = """lateral (select unnest(range(cast(floor(lat0/0.01e0) as bigint), cast(floor(lat1/0.01e0) as bigint)+1)) tile_s) ts,
   lateral (select unnest(range(cast(floor(lon0/0.01e0) as bigint), cast(floor(lon1/0.01e0) as bigint)+1)) tile_w) tw"""


def ways(t):
    return ft.way_geometry(t.way_node, t.node)


@query("way_geometry", f"""select way_id, count(*) n, round(arg_min(lat,seq),7) first_lat, round(arg_max(lon,seq),7) last_lon,
    round(sum(lat*rn),5) lat_sum from (select *, row_number() over (partition by way_id order by seq) rn from {WAY_PTS} p) q group by way_id having count(*)>=2""")
def way_geometry(t):
    g = F.col("geom")
    total = F.aggregate(F.transform(g, lambda p, i: p["lat"] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return ways(t).select(
        "way_id", big(F.size(g)).alias("n"), F.round(F.element_at(g, 1)["lat"], 7).alias("first_lat"),
        F.round(F.element_at(g, -1)["lon"], 7).alias("last_lon"), F.round(total, 5).alias("lat_sum"),
    )


@query("features_to_tiles", f"select way_id, tile_s, tile_w from {WAY_BOX} b, {TILES}")
def features_to_tiles(t):
    return ft.each_tile(ft.way_tile_ranges(t.way_node, t.node)).select("way_id", "tile_s", "tile_w")


LAYER_SQL = "(case when highway in ('motorway','primary','residential','footway') then 'roads' end)"


def road_features(t):
    """Classified ways with geometry, as ``feature_id, layer, geom``."""
    tagged = ways(t).join(way_tags(t), "way_id")
    return ft.classify_ways(tagged).withColumnRenamed("way_id", "feature_id")


@query("bbox_features", f"select 'roads' layer, tile_s, tile_w, count(*) n from (select b.* from {WAY_BOX} b join way_tag g on g.way_id=b.way_id and {LAYER_SQL} is not null) b, {TILES} group by tile_s, tile_w")
def bbox_features(t):
    return ft.bbox_features(road_features(t))


# Part rows as elements: each part is a way of one kind of tag, on a square or an open line.
KINDS = ["building", "highway=primary", "highway=track", "natural=water", "natural=wood", "natural=peak", "waterway=dam", "waterway=river", "waterway=ditch",
         "leisure=park", "leisure=pitch", "leisure=garden", "landuse=grass", "landuse=farmland", "railway=rail", "barrier=fence", "barrier=kerb", "power=line", "power=pole",
         "aeroway=runway", "tourism=museum", "surface=mud"]
WANT = {"building": ["buildings"], "highway=primary": ["roads"], "natural=water": ["water"], "natural=wood": ["land_areas"], "waterway=dam": ["dams"],
        "leisure=park": ["parks", "land_areas"], "leisure=pitch": ["land_areas"], "landuse=grass": ["parks", "land_areas"], "landuse=farmland": ["land_areas"],
        "railway=rail": ["railways"], "barrier=fence": ["barriers"], "power=line": ["power"], "aeroway=runway": ["aeroways"], "tourism=museum": ["extra_ways"]}


def element_ways(t):
    """``way_id, kind, tags, geom``; even ids are closed squares."""
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    df = t.part.select(F.col("p_partkey").alias("way_id"), kind.alias("kind"), F.col("p_size").alias("s"))
    key, value = F.split_part("kind", F.lit("="), F.lit(1)), F.split_part("kind", F.lit("="), F.lit(2))
    y, x = F.col("way_id") % 100 * 0.0005 - 27.5, F.floor(F.col("way_id") / 100.0) * 0.0005 + 153.0
    a, b, c, d = gm.point(y, x), gm.point(y, x + 0.0002), gm.point(y + 0.0002, x + 0.0002), gm.point(y + 0.0002, x)
    geom = F.when(F.col("way_id") % 2 == 0, F.array(a, b, c, d, a)).otherwise(F.array(a, b, c, d))
    return df.select("way_id", "kind", F.create_map(key, F.when(value == "", "yes").otherwise(value)).alias("tags"), geom.alias("geom"))


def _layers_sql():
    arms = []
    for i, k in enumerate(KINDS):
        for layer in WANT.get(k, []):
            arms.append(f"select p_partkey way_id, '{layer}' layer from part where p_partkey % {len(KINDS)} = {i}")
        if k == "waterway=river":
            arms.append(f"select p_partkey way_id, case when p_partkey % 2 = 0 then 'water' else 'waterway_lines' end layer from part where p_partkey % {len(KINDS)} = {i}")
    return " union all ".join(arms)


@query("classify_elements", _layers_sql())
def classify_elements(t):
    return ft.classify_ways(element_ways(t)).select("way_id", "layer")


@query("classify_elements_live", " union all ".join(
    f"select p_partkey way_id, {layer} layer from part where p_partkey % {len(KINDS)} = {KINDS.index(k)}" for k, layer in {
        "building": "'buildings'", "highway=primary": "'roads'", "highway=track": "'roads'", "natural=water": "'water'", "natural=wood": "'land_areas'",
        "waterway=dam": "case when p_partkey % 2=0 then 'water' else 'waterway_lines' end", "waterway=river": "case when p_partkey % 2=0 then 'water' else 'waterway_lines' end",
        "waterway=ditch": "case when p_partkey % 2=0 then 'water' else 'waterway_lines' end", "leisure=park": "'parks'", "leisure=pitch": "'land_areas'", "landuse=grass": "'land_areas'",
        "landuse=farmland": "'land_areas'", "railway=rail": "'railways'", "barrier=fence": "'barriers'", "barrier=kerb": "'barriers'", "power=line": "'power'", "power=pole": "'power'",
        "aeroway=runway": "'aeroways'"}.items()))
def classify_elements_live(t):
    return ft.classify_ways(element_ways(t), "live").select("way_id", "layer")


@query("accept_way", f"select p_partkey way_id from part where p_partkey % {len(KINDS)} <> {KINDS.index('surface=mud')}")
def accept_way(t):
    return element_ways(t).where(rules.accept_way("tags")).select("way_id")


@query("accept_poi", f"select p_partkey way_id from part where p_partkey % {len(KINDS)} in ({KINDS.index('tourism=museum')}, {KINDS.index('natural=peak')})")
def accept_poi(t):
    return element_ways(t).where(rules.accept_poi("tags")).select("way_id")


CLIP = "lat_max>=-27.48e0 and lat_min<=-27.46e0 and lon_max>=153.001e0 and lon_min<=153.006e0"


@query("clip_features", f"""with el as (select p_partkey id, p_partkey % {len(KINDS)} k, p_partkey % 2 odd, -27.5e0+(p_partkey % 100)*0.0005e0 y, 153e0+floor(p_partkey/100e0)*0.0005e0 x from part),
    f as (select e.way_id, e.layer, y, x, odd from ({_layers_sql()}) e join el on el.id=e.way_id)
    select way_id, layer from f where case when layer='buildings' then (case when odd=1 then y+0.0001e0 else y+0.00008e0 end) between -27.48e0 and -27.46e0 and (case when odd=1 then x+0.0001e0 else x+0.00008e0 end) between 153.001e0 and 153.006e0
      when layer in ('water','waterway_lines','parks','land_areas') or (layer='aeroways' and odd=0) then y+0.0002e0>=-27.48e0 and y<=-27.46e0 and x+0.0002e0>=153.001e0 and x<=153.006e0
      else (y between -27.48e0 and -27.46e0 or y+0.0002e0 between -27.48e0 and -27.46e0) and (x between 153.001e0 and 153.006e0 or x+0.0002e0 between 153.001e0 and 153.006e0) end""")
def clip_features(t):
    return ft.clip_features(ft.classify_ways(element_ways(t)), -27.48, -27.46, 153.001, 153.006).select("way_id", "layer")


# Chunk boxes around the sites; water and lines come from polygons and lines of the sites.
CHUNK_BOX = "(select site_id chunk_id, lat-0.0021e0 lat_min, lat+0.0017e0 lat_max, lon-0.0013e0 lon_min, lon+0.0019e0 lon_max, lat-0.0002e0 cy, lon+0.0003e0 cx from site)"
FEATS = """(select poly_id fid, 'water' layer, min(lat) lat0, max(lat) lat1, min(lon) lon0, max(lon) lon1 from poly_vertex where poly_id % 3 = 0 group by poly_id
   union all select poly_id, 'parks', min(lat), max(lat), min(lon), max(lon) from poly_vertex where poly_id % 3 = 1 group by poly_id
   union all select line_id, 'waterway_lines', min(lat), max(lat), min(lon), max(lon) from line_vertex where line_id % 2 = 0 group by line_id
   union all select line_id, 'roads', min(lat), max(lat), min(lon), max(lon) from line_vertex where line_id % 2 = 1 group by line_id)"""


def site_features(t):
    p = t.polygons.select(F.col("poly_id").alias("feature_id"), F.when(F.col("poly_id") % 3 == 0, "water").when(F.col("poly_id") % 3 == 1, "parks").alias("layer"), F.col("polygon").alias("geom"))
    l = t.lines.select(F.col("line_id").alias("feature_id"), F.when(F.col("line_id") % 2 == 0, "waterway_lines").otherwise("roads").alias("layer"), F.col("line").alias("geom"))
    return p.where(F.col("layer").isNotNull()).unionByName(l)


def site_chunks(t):
    return t.sql(f"select chunk_id, lat_min, lat_max, lon_min, lon_max from {CHUNK_BOX} c")


@query("chunk_features", f"""with c as {CHUNK_BOX}, f as {FEATS}, tiled as (select fid, layer, lat0, lat1, lon0, lon1, tile_s, tile_w from f, {TILES}),
    near as (select distinct c.chunk_id, f.fid, f.layer, f.lat0, f.lat1, f.lon0, f.lon1, c.lat_min-0.0003e0 y0, c.lat_max+0.0003e0 y1, c.lon_min-0.0003e0 x0, c.lon_max+0.0003e0 x1
      from c join tiled f on abs(f.tile_s-floor((c.lat_min+c.lat_max)*0.5e0/0.01e0))<=1 and abs(f.tile_w-floor((c.lon_min+c.lon_max)*0.5e0/0.01e0))<=1
      where f.layer in ('water','waterway_lines') or (f.tile_s=floor((c.lat_min+c.lat_max)*0.5e0/0.01e0) and f.tile_w=floor((c.lon_min+c.lon_max)*0.5e0/0.01e0)))
    select chunk_id, layer, fid feature_id from near n where (layer in ('water','waterway_lines','parks') and lat1>=y0 and lat0<=y1 and lon1>=x0 and lon0<=x1)
      or (layer='roads' and exists (select 1 from line_vertex v where v.line_id=n.fid and v.lat between y0 and y1 and v.lon between x0 and x1))""")
def chunk_features(t):
    tiled = ft.features_to_tiles(site_features(t))
    return ft.chunk_features(site_chunks(t), tiled).select("chunk_id", "layer", "feature_id")


GAP = """with c as (select site_id chunk_id, lat, lon, ux/l ux, uy/l uy from (select s.*, v4.lat-v1.lat ux, v4.lon-v1.lon uy, sqrt(power(v4.lat-v1.lat,2e0)+power(v4.lon-v1.lon,2e0)) l from site s
     join line_vertex v1 on v1.line_id=s.site_id and v1.seq=1 join line_vertex v4 on v4.line_id=s.site_id and v4.seq=4) q),
   steps as (select c.*, side, step, cast(floor((lat+ux*step*0.012e0*side)/0.01e0) as bigint) ts, cast(floor((lon+uy*step*0.012e0*side)/0.01e0) as bigint) tw from c, (select -1 side union all select 1) a, range(1,60) r(step)),
   w as (select poly_id, min(lat) lat0, max(lat) lat1, min(lon) lon0, max(lon) lon1 from poly_vertex where poly_id % 3 = 0 group by poly_id),
   tiled as (select poly_id, tile_s, tile_w from w, {tiles}),
   first as (select chunk_id, side, arg_min(ts,step) ts, arg_min(tw,step) tw, any_value(lat) lat, any_value(lon) lon, any_value(ux) ux, any_value(uy) uy from steps s
     where (ts<>floor(lat/0.01e0) or tw<>floor(lon/0.01e0)) and exists (select 1 from tiled t where t.tile_s=s.ts and t.tile_w=s.tw) group by chunk_id, side),
   pts as (select f.chunk_id, f.side, v.lat py, v.lon px, abs(v.lat*ux+v.lon*uy-(f.lat*ux+f.lon*uy)) d, v.lon*ux-v.lat*uy x from first f join tiled t on t.tile_s=f.ts and t.tile_w=f.tw join poly_vertex v on v.poly_id=t.poly_id),
   ends as (select chunk_id, side, arg_max(py,x) ly, arg_max(px,x) lx, arg_min(py,x) ry, arg_min(px,x) rx from (select *, min(d) over (partition by chunk_id, side) m from pts) p where d<=m+0.01e0 group by chunk_id, side)
   select a.chunk_id, round(a.ly,7) la_lat, round(a.lx,7) la_lon, round(a.ry,7) ra_lat, round(b.rx,7) rb_lon, round(b.ly,7) lb_lat from ends a join ends b on a.chunk_id=b.chunk_id and a.side=-1 and b.side=1""".replace("{tiles}", TILES)


@query("gap_bridge", GAP)
def gap_bridge(t):
    ends = t.lines.select(F.col("line_id").alias("chunk_id"), F.element_at("line", 1).alias("a"), F.element_at("line", -1).alias("b"))
    chunks = t.site.select(F.col("site_id").alias("chunk_id"), "lat", "lon").join(ends, "chunk_id").select(
        "chunk_id", "lat", "lon", F.col("a.lat").alias("first_lat"), F.col("a.lon").alias("first_lon"), F.col("b.lat").alias("last_lat"), F.col("b.lon").alias("last_lon"))
    water = t.polygons.where(F.col("poly_id") % 3 == 0).select("poly_id", F.col("polygon").alias("geom"))
    q = ft.gap_bridge(chunks, ft.features_to_tiles(water))
    at = lambda i: F.element_at("quad", i)
    return q.select("chunk_id", F.round(at(1)["lat"], 7).alias("la_lat"), F.round(at(1)["lon"], 7).alias("la_lon"), F.round(at(2)["lat"], 7).alias("ra_lat"),
                    F.round(at(3)["lon"], 7).alias("rb_lon"), F.round(at(4)["lat"], 7).alias("lb_lat"))


@query("points_in_polygons", f"select poly_id, count(*) n, min(event_id) first_event from {inside_sql('position', 'event_id')} h group by poly_id")
def points_in_polygons(t):
    # Counted per class of equal polygons, so copies add a row each and no pairs.
    ready = sj.polygon_classes(t.polygons.select("poly_id", "polygon"))
    hits = sj.points_in_classes(t.position.select("event_id", "lat", "lon"), ready, ["event_id"])
    held = hits.groupBy(*sj.CLASS).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")).join(ready, sj.CLASS)
    return held.groupBy("poly_id").agg(F.sum("n").alias("n"), F.min("first_event").alias("first_event"))


@query("tile_probe", f"""with f as (select poly_id fid, 'water' layer, min(lat) lat0, max(lat) lat1, min(lon) lon0, max(lon) lon1 from poly_vertex where poly_id % 3=0 group by poly_id
     union all select line_id, 'waterway_lines', min(lat), max(lat), min(lon), max(lon) from line_vertex where line_id % 2=0 group by line_id),
   near as (select p.site_id probe_id, p.lat, p.lon, f.fid feature_id, f.layer from site p join (select * from f, {TILES}) f on f.tile_s=floor(p.lat/0.01e0) and f.tile_w=floor(p.lon/0.01e0))
   select n.probe_id, n.layer, n.feature_id from near n join {inside_sql('site', 'site_id')} h on h.site_id=n.probe_id and h.poly_id=n.feature_id where n.layer='water'
   union all select probe_id, layer, feature_id from (select n.probe_id, n.layer, n.feature_id, power(a_lat+t*(b_lat-a_lat)-n.lat,2e0)+power(a_lon+t*(b_lon-a_lon)-n.lon,2e0) d from near n join {SEG_SQL} s on s.line_id=n.feature_id and n.layer='waterway_lines',
     lateral (select least(greatest(((n.lat-a_lat)*(b_lat-a_lat)+(n.lon-a_lon)*(b_lon-a_lon))/(power(b_lat-a_lat,2e0)+power(b_lon-a_lon,2e0)),0e0),1e0) t) k) q where d<=0.002e0*0.002e0 group by all""")
def tile_probe(t):
    probes = t.site.select(F.col("site_id").alias("probe_id"), "lat", "lon")
    flows = site_features(t).where(F.col("layer").isin("water", "waterway_lines"))
    return ft.tile_probe(probes, ft.features_to_tiles(flows)).select("probe_id", "layer", "feature_id")


NEAREST = f"""(select p.event_id, s.line_id, s.seg, d.dist_m, d.t from position p join {SEG_SQL} s on s.a_lat between p.lat-0.02e0 and p.lat+0.02e0,
   lateral (select {dist_t_sql('p.lat', 'p.lon').replace('a_l', 's.a_l').replace('b_l', 's.b_l')}) d where d.dist_m < 300e0)"""


@query("nearest_segment", f"select event_id, line_id, round(dist_m,4) dist_m, round(seg+t,6) pos from {NEAREST} q qualify row_number() over (partition by event_id order by dist_m, line_id, seg)=1")
def nearest_segment(t):
    out = sj.nearest_segment(t.position, sj.explode_segments(t.lines), ["event_id"], ["line_id", "seg"], 300.0, 300.0, inclusive=False)
    return out.select("event_id", "line_id", F.round("dist_m", 4).alias("dist_m"), F.round(F.col("seg") + F.col("t"), 6).alias("pos"))


@query("dedup_first_feature", f"select poly_id, min(lat0) lat from (select poly_id, round(lat0,7) lat0 from (select fid poly_id, lat0 from {FEATS} f where layer='water') a, (select 1 union all select 2) b) q group by poly_id")
def dedup_first_feature(t):
    from ..operators.ground import first_feature

    water = t.polygons.where(F.col("poly_id") % 3 == 0).select("poly_id", gm.bbox_of_geometry("polygon")["lat_min"].alias("lat"))
    twice = water.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    return first_feature(twice, "poly_id").select("poly_id", F.round("lat", 7).alias("lat"))


@query("dedup_line_start", "select cast(round(lat*100000e0) as bigint) ky, cast(round(lon*100000e0) as bigint) kx, min(line_id) line_id from line_vertex where seq=1 group by 1, 2")
def dedup_line_start(t):
    from ..operators.rivers import dedup_lines

    out = dedup_lines(t.lines.withColumn("seq", F.col("line_id")))
    return out.select("ky", "kx", "line_id")


def relation_members(t):
    """One relation per customer with four outer arcs of a square, alternately reversed, and one inner square."""
    from ..functions.geometry import point

    y, x = F.col("c_custkey") % 100 * 0.001 - 27.5, F.floor(F.col("c_custkey") / 100.0) * 0.001 + 153.0
    c = [point(y, x), point(y, x + 0.0008), point(y + 0.0008, x + 0.0008), point(y + 0.0008, x)]
    flip = F.col("c_custkey") % 2 == 0

    def member(seq, role, geom):
        return F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(role).alias("role"), geom.alias("geom"))

    arcs = [member(i, "outer", F.when(flip & (F.lit(i) % 2 == 1), F.array(c[(i + 1) % 4], c[i])).otherwise(F.array(c[i], c[(i + 1) % 4]))) for i in range(4)]
    arcs.append(member(4, "inner", F.array(c[0], c[1], c[2], c[0])))
    df = t.customer.select(F.col("c_custkey").alias("relation_id"), F.explode(F.array(*arcs)).alias("m"))
    return df.select("relation_id", "m.*")


@query("relation_rings", "select c_custkey relation_id, cast(i as bigint) seq, case when i<4 then 'outer' else 'inner' end as role, cast(case when i<4 then 2 else 4 end as bigint) n from customer, range(5) r(i)")
def relation_rings(t):
    m = relation_members(t)
    way = (F.col("relation_id") * 10 + F.col("seq")).alias("way_id")
    ways_ = m.select(way, "geom")
    rel = m.groupBy(F.col("relation_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", way.alias("ref"), "role"))).alias("s"))
    rel = rel.select("id", F.transform("s", lambda x: F.struct(x["ref"].alias("ref"), x["role"].alias("role"))).alias("members"))
    out = ft.relation_rings(rel, ways_)
    return out.select("relation_id", "seq", "role", big(F.size("geom")).alias("n"))


RING = "select c_custkey relation_id, cast({n} as bigint) n, round(-27.5e0+(c_custkey % 100)*0.001e0,7) lat from customer"


@query("ring_stitch", RING.format(n=5))
def ring_stitch(t):
    out = ft.ring_stitch(relation_members(t))
    return out.select("relation_id", big(F.size("geom")).alias("n"), F.round(F.element_at("geom", -1)["lat"], 7).alias("lat"))


@query("chain_stitch", RING.format(n=5))
def chain_stitch(t):
    out = ft.chain_stitch(relation_members(t))
    return out.select("relation_id", big(F.size("geom")).alias("n"), F.round(F.element_at("geom", -1)["lat"], 7).alias("lat"))


@query("region_tile_extract", f"select tile_s, tile_w, (tile_s*0.01e0+0.01e0>=-27.52e0 and tile_s*0.01e0<=-27.43e0 and tile_w*0.01e0+0.01e0>=152.98e0 and tile_w*0.01e0<=153.07e0) inside from (select distinct tile_s, tile_w from {FEATS} f, {TILES}) q")
def region_tile_extract(t):
    from ..operators.directory import region_tile_extract

    tiles = ft.features_to_tiles(site_features(t)).select("tile_s", "tile_w").distinct()
    return region_tile_extract(tiles, -27.5, -27.45, 153.0, 153.05)


@query("tile_inventory_diff", f"""select s tile_s, w tile_w from range(-2765,-2735) a(s), range(15300,15325) b(w) where not exists (select 1 from {FEATS} f, {TILES} where tile_s=s and tile_w=w)""")
def tile_inventory_diff(t):
    from ..operators.directory import tile_inventory_diff
    from ..operators.elevation import grid_cells
    from ..operators.spatial_join import Grid

    held = ft.features_to_tiles(site_features(t)).select("tile_s", "tile_w").distinct()
    box = grid_cells(t.spark, Grid(-27.65, 153.0, 0.01, 30, 25))
    need = box.select((F.col("r") - 2765).alias("tile_s"), (F.col("c") + 15300).alias("tile_w"))
    return tile_inventory_diff(need, held)


def map_objects(t):
    from ..operators.inference import infer_objects

    nodes = t.node.withColumn("amenity", F.when(F.col("node_id") % 5 == 0, "bench").when(F.col("node_id") % 5 == 1, "post_box"))
    tags = F.when(F.col("node_id") % 7 == 0, F.create_map(F.lit("highway"), F.lit("street_lamp"))).otherwise(F.create_map(F.lit("power"), F.lit("tower")))
    verts = t.line_vertex.select(F.col("line_id").alias("way_id"), "seq", "lat", "lon", F.when(F.col("category") % 3 == 0, "Path").otherwise("Primary").alias("cls"))
    return infer_objects(nodes.where(F.col("amenity").isNotNull()), nodes.withColumn("tags", tags), verts)


@query("infer_objects")
def infer_objects(t):
    return map_objects(t).select("object_id", "kind", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))
