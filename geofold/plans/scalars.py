"""Queries for geodesy, keys, geometry and classification functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import clocks, geo, geometry as gm, rules
from ..functions.geo import big
from .catalog import query

# Fixed WGS84 terms, written into the SQL as literals.
A, B = geo.WGS84_A, geo.WGS84_B
E2 = 1.0 - (B * B) / (A * A)
EP2 = (A * A) / (B * B) - 1.0
PI = math.pi


def ecef_sql(lat: str, lon: str, alt: str) -> str:
    """x, y, z of a point, as three SQL expressions."""
    n = f"({A!r}e0/sqrt(1e0-{E2!r}*sin(radians({lat}))*sin(radians({lat}))))"
    return (
        f"({n}+({alt}))*cos(radians({lat}))*cos(radians({lon})) x, "
        f"({n}+({alt}))*cos(radians({lat}))*sin(radians({lon})) y, "
        f"({n}*{1.0 - E2!r}+({alt}))*sin(radians({lat})) z"
    )


def gps_sql(source: str) -> str:
    """A sub-select over ``x, y, z`` columns that adds lat, lon and alt."""
    return (
        f"(select *, degrees(la) lat, degrees(atan2(y,x)) lon, p*cos(la)+z*sin(la)-{A!r}*sqrt(1e0-{E2!r}*sin(la)*sin(la)) alt "
        f"from (select *, atan2(z+{EP2 * B!r}*power(sin(th),3e0), p-{E2 * A!r}*power(cos(th),3e0)) la "
        f"from (select *, atan2(z*{B!r}*(1e0+{EP2 * B!r}/sqrt(x*x+y*y+z*z)), p*{A!r}) th from (select *, sqrt(x*x+y*y) p from {source}) q1) q2) q3)"
    )


def rounded(df, digits, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("gps_to_ecef", f"select event_id, round(x,4) x, round(y,4) y, round(z,4) z from "
       f"(select event_id, {ecef_sql('lat', 'lon', 'alt')} from position) q")
def gps_to_ecef(t):
    df = t.position.select("event_id", geo.gps_to_ecef("lat", "lon", "alt").alias("p")).select("event_id", "p.*")
    return rounded(df, 4, "x", "y", "z")


@query("ecef_to_gps", f"""select event_id, round(lat,8) lat, round(lon,8) lon, round(alt,3) alt from
    {gps_sql(f"(select event_id, {ecef_sql('lat', 'lon', 'alt')} from position)")} g""")
def ecef_to_gps(t):
    p = t.position.select("event_id", geo.gps_to_ecef("lat", "lon", "alt").alias("p")).select("event_id", "p.*")
    df = p.select("event_id", geo.ecef_to_gps("x", "y", "z").alias("g")).select("event_id", "g.*")
    return df.select("event_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("alt", 3).alias("alt"))


def _ordered_pairs(t):
    """Each site with the next one by id within its category."""
    from pyspark.sql import Window

    w = Window.partitionBy("category").orderBy("site_id")
    df = t.site
    for c in ("lat", "lon", "alt"):
        df = df.withColumn(f"{c}2", F.lead(c).over(w))
    return df.where(F.col("lat2").isNotNull())


PAIR_SQL = """(select * from (select site_id, lat, lon, alt, lead(lat) over w lat2, lead(lon) over w lon2, lead(alt) over w alt2
    from site window w as (partition by category order by site_id)) q where lat2 is not null)"""


@query("ecef_distance", f"""select site_id, round(sqrt(power(x-x2,2e0)+power(y-y2,2e0)+power(z-z2,2e0)),4) dist_m from
    (select site_id, {ecef_sql('lat', 'lon', 'alt')}, {ecef_sql('lat2', 'lon2', 'alt2').replace(' x,', ' x2,').replace(' y,', ' y2,')}2
     from {PAIR_SQL} p) q""")
def ecef_distance(t):
    df = _ordered_pairs(t).withColumn("a", geo.gps_to_ecef("lat", "lon", "alt")).withColumn(
        "b", geo.gps_to_ecef("lat2", "lon2", "alt2")
    )
    return df.select("site_id", F.round(geo.ecef_distance("a.x", "a.y", "a.z", "b.x", "b.y", "b.z"), 4).alias("dist_m"))


HAVERSINE = ("2e0*6371000e0*atan2(sqrt({a}), sqrt(1e0-({a})))").replace(
    "{a}", "(power(sin(radians({y2}-{y1})/2e0),2e0)+cos(radians({y1}))*cos(radians({y2}))*power(sin(radians({x2}-{x1})/2e0),2e0))"
)


def haversine_sql(y1, x1, y2, x2):
    return HAVERSINE.format(y1=y1, x1=x1, y2=y2, x2=x2)


@query("haversine_m", f"select site_id, round({haversine_sql('lat', 'lon', 'lat2', 'lon2')},4) dist_m from {PAIR_SQL} p")
def haversine_m(t):
    return _ordered_pairs(t).select("site_id", F.round(geo.haversine_m("lat", "lon", "lat2", "lon2"), 4).alias("dist_m"))


@query("bearing_deg", f"""select site_id, round(fmod(degrees(atan2(sin(radians(lon2-lon))*cos(radians(lat2)),
    cos(radians(lat))*sin(radians(lat2))-sin(radians(lat))*cos(radians(lat2))*cos(radians(lon2-lon))))+360e0, 360e0),6) bearing
    from {PAIR_SQL} p""")
def bearing_deg(t):
    return _ordered_pairs(t).select("site_id", F.round(geo.bearing_deg("lat", "lon", "lat2", "lon2"), 6).alias("bearing"))


@query("offset_lat_lon", """select site_id, round(lat + alt/111320e0, 9) lat,
    round(lon + (alt*0.5e0)/(111320e0*greatest(abs(cos(radians(lat))),0.1e0)), 9) lon from site""")
def offset_lat_lon(t):
    df = t.site.select("site_id", geo.offset_lat_lon("lat", "lon", "alt", F.col("alt") * 0.5).alias("p"))
    return rounded(df.select("site_id", "p.*"), 9, "lat", "lon")


@query("bbox_for_site", """select site_id, round(lat-120e0/111320e0,9) lat_min, round(lat+120e0/111320e0,9) lat_max,
    round(lon-120e0/(111320e0*greatest(abs(cos(radians(lat))),0.1e0)),9) lon_min,
    round(lon+120e0/(111320e0*greatest(abs(cos(radians(lat))),0.1e0)),9) lon_max from site""")
def bbox_for_site(t):
    df = t.site.select("site_id", geo.bbox_for_site("lat", "lon", F.lit(240.0)).alias("b")).select("site_id", "b.*")
    return rounded(df, 9, "lat_min", "lat_max", "lon_min", "lon_max")


# Points spread over the globe from order keys.
GLOBE = "(select o_orderkey id, (o_orderkey % 1801)*0.1e0-90e0 lat, (o_orderkey % 3607)*0.1e0-180e0 lon, o_totalprice/1000e0-20e0 elev from orders)"

GEOID_SQL = """case when lat between -50e0 and -10e0 and l between 110e0 and 180e0
      then least(greatest(33.2e0-0.38e0*(lat+27e0)+0.14e0*(l-153e0),20e0),45e0)
    when lat between 35e0 and 72e0 and (l<=30e0 or l>=350e0) then least(greatest(47e0-0.35e0*(lat-53e0),30e0),60e0)
    when lat between 24e0 and 55e0 and l between 255e0 and 300e0
      then least(greatest(-18e0-0.4e0*(lat-40e0)+0.12e0*(l-280e0),-40e0),15e0)
    when lat between -10e0 and 15e0 and l between 60e0 and 100e0
      then least(-100e0+1.2e0*sqrt(power(lat-5e0,2e0)+power(l-78e0,2e0)),-20e0)
    else least(greatest(10e0-15e0*(3e0*power(sin(radians(lat)),2e0)-1e0)
      +1.5e0*(35e0*power(sin(radians(lat)),4e0)-30e0*power(sin(radians(lat)),2e0)+3e0),-110e0),85e0) end"""


def globe(t):
    return t.sql(f"select * from {GLOBE} g")


@query("geoid_undulation", f"select id, round({GEOID_SQL},6) n_m from (select *, fmod(lon+360e0,360e0) l from {GLOBE} g) q")
def geoid_undulation(t):
    return globe(t).select("id", F.round(geo.geoid_undulation("lat", "lon"), 6).alias("n_m"))


@query("wrap_lon", f"""select id, round(case when x > 180e0 then lon-360e0*ceil((x-180e0)/360e0)
    when x < -180e0 then lon+360e0*ceil((-x-180e0)/360e0) else lon end,6) lon from (select id, lon, lon-170.05e0 x from {GLOBE} g) q""")
def wrap_lon(t):
    return globe(t).select("id", F.round(geo.wrap_lon("lon", F.lit(170.05)), 6).alias("lon"))


COLUMN_XYZ = f"""(select vx, vz, x, case when y2>0 then sqrt(y2)*sign(-5000000e0) else -5000000e0 end y, z from
   (select vx, vz, x, z, {A * A!r}*(1e0-power(z/{B!r},2e0))-x*x y2 from
   (select vx, vz, vx+0.5e0-6400000e0 x, vz+0.5e0-6400000e0 z from
   (select distinct 1340000+(o_orderkey % 211)*17 vx, 3480000+(o_orderkey % 173)*13 vz from orders) c0) c1) c2)"""


@query("column_gps", f"select vx, vz, round(lat,9) lat, round(lon,9) lon from {gps_sql(COLUMN_XYZ)} g")
def column_gps(t):
    df = t.sql("select distinct 1340000+(o_orderkey % 211)*17 vx, 3480000+(o_orderkey % 173)*13 vz from orders")
    df = df.withColumn("g", geo.column_gps("vx", "vz", F.lit(-5000000.0)))
    return df.select("vx", "vz", F.round("g.lat", 9).alias("lat"), F.round("g.lon", 9).alias("lon"))


CHUNK_CORNERS = f"""(select cx, cz, x, case when y2>0 then sqrt(y2)*sign(-5000000e0) else -5000000e0 end y, z from
   (select cx, cz, x, z, {A * A!r}*(1e0-power(z/{B!r},2e0))-x*x y2 from
   (select cx, cz, cx*30+dx+0.5e0-6400000e0 x, cz*30+dz+0.5e0-6400000e0 z from
   (select distinct 44600+o_orderkey % 41 cx, 116000+o_orderkey % 37 cz from orders) c0,
   (select 0 dx union all select 29) a, (select 0 dz union all select 29) b) c1) c2)"""


@query("chunk_gps_box", f"""select cx, cz, round(min(lat)-0.00015e0,8) lat_min, round(max(lat)+0.00015e0,8) lat_max,
    round(min(lon)-0.00015e0,8) lon_min, round(max(lon)+0.00015e0,8) lon_max from {gps_sql(CHUNK_CORNERS)} g group by cx, cz""")
def chunk_gps_box(t):
    df = t.sql("select distinct 44600+o_orderkey % 41 cx, 116000+o_orderkey % 37 cz from orders")
    df = df.select("cx", "cz", geo.chunk_gps_box("cx", "cz", F.lit(-5000000.0)).alias("b")).select("cx", "cz", "b.*")
    return rounded(df, 8, "lat_min", "lat_max", "lon_min", "lon_max")


@query("voxel_of_ecef", f"""select event_id, cast(floor(x+6400000e0) as bigint) vx, cast(floor(y+6400000e0) as bigint) vy,
    cast(floor(z+6400000e0) as bigint) vz from (select event_id, {ecef_sql('lat', 'lon', 'alt')} from position) q""")
def voxel_of_ecef(t):
    p = t.position.select("event_id", geo.gps_to_ecef("lat", "lon", "alt").alias("p"))
    return p.select("event_id", *[geo.voxel_of_ecef(f"p.{a}").alias(f"v{a}") for a in "xyz"])


@query("ecef_of_voxel", "select op_id, vx+0.5e0-6400000e0 x, vy+0.5e0-6400000e0 y, vz+0.5e0-6400000e0 z from op_log")
def ecef_of_voxel(t):
    return t.op_log.select("op_id", *[geo.ecef_of_voxel(f"v{a}").alias(a) for a in "xyz"])


# Voxels on both sides of zero, so that floor and truncation differ.
VOXELS = "(select o_orderkey id, o_orderkey % 301 - 150 vx, o_custkey % 1203 - 600 vy, o_orderkey % 277 - 140 vz from orders)"


def voxels(t):
    return t.sql(f"select * from {VOXELS} v")


CHUNK_SQL = "cast(floor(vx/30e0) as bigint) cx, cast(floor(vy/200e0) as bigint) cy, cast(floor(vz/30e0) as bigint) cz"


@query("chunk_of_voxel", f"select id, {CHUNK_SQL} from {VOXELS} v")
def chunk_of_voxel(t):
    df = voxels(t).select("id", geo.chunk_of_voxel("vx", "vy", "vz").alias("c"))
    return df.select("id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


@query("chunk_bounds", f"""select distinct cx, cy, cz, cx*30 x0, cx*30+30 x1, cy*200 y0, cy*200+200 y1, cz*30 z0, cz*30+30 z1
    from (select {CHUNK_SQL} from {VOXELS} v) q""")
def chunk_bounds(t):
    from ..operators.chunks import chunk_bounds

    return chunk_bounds(chunk_of_voxel(t).drop("id").distinct())


@query("chunk_contains", f"""select id, vx>=0 and vx<30 and vy>=-200 and vy<0 and vz>=-30 and vz<0 inside from {VOXELS} v""")
def chunk_contains(t):
    from ..operators.chunks import chunk_contains

    return voxels(t).select("id", chunk_contains(F.lit(0), F.lit(-1), F.lit(-1), "vx", "vy", "vz").alias("inside"))


@query("chunk_neighbours", f"""select cx, cy, cz, cx+dx nx, cy+dy ny, cz+dz nz from (select distinct {CHUNK_SQL} from {VOXELS} v) q,
    (select -1 dx union all select 0 union all select 1) a, (select -1 dy union all select 0 union all select 1) b,
    (select -1 dz union all select 0 union all select 1) c where dx<>0 or dy<>0 or dz<>0""")
def chunk_neighbours(t):
    from ..operators.chunks import chunk_neighbours

    return chunk_neighbours(chunk_of_voxel(t).drop("id").distinct())


@query("chunk_manhattan", f"select id, abs(cx-1)+abs(cy+2)+abs(cz-3) dist from (select id, {CHUNK_SQL} from {VOXELS} v) q")
def chunk_manhattan(t):
    df = chunk_of_voxel(t)
    return df.select("id", (F.abs(F.col("cx") - 1) + F.abs(F.col("cy") + 2) + F.abs(F.col("cz") - 3)).alias("dist"))


AFFECTED_SQL = f"""select distinct id, cast(floor((vx+dx)/30e0) as bigint) cx, cast(floor((vy+dy)/200e0) as bigint) cy,
    cast(floor((vz+dz)/30e0) as bigint) cz from {VOXELS} v, (select -1 dx union all select 0) a, (select -1 dy union all select 0) b,
    (select -1 dz union all select 0) c"""


@query("affected_chunks", AFFECTED_SQL)
def affected_chunks(t):
    from ..operators.chunks import affected_chunks

    df = voxels(t).select("id", F.explode(affected_chunks("vx", "vy", "vz")).alias("c"))
    return df.select("id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


@query("op_chunks", f"""select id, cx, cy, cz from (select id from {VOXELS} v where id % 3 = 0) k join ({AFFECTED_SQL}) a using (id)
    union all select id, cast(floor(vx/30e0) as bigint)+i, cast(floor(vy/200e0) as bigint), cast(floor(vz/30e0) as bigint)+k
    from {VOXELS} v, (select 0 i union all select 1 union all select 2) a, (select 0 k union all select 1) b
    where id % 3 = 1 and i <= floor((vx+40)/30e0)-floor(vx/30e0) and k <= floor((vz+10)/30e0)-floor(vz/30e0)""")
def op_chunks(t):
    from ..operators.chunks import op_chunks

    kind = F.when(F.col("id") % 3 == 0, "SetVoxel").when(F.col("id") % 3 == 1, "FillRegion").otherwise("GrantAccess")

    def vox(dx, dz):
        return F.struct((F.col("vx") + dx).alias("x"), F.col("vy").alias("y"), (F.col("vz") + dz).alias("z"))

    ops = voxels(t).select("id", kind.alias("action"), vox(0, 0).alias("coord"), vox(0, 0).alias("box_min"), vox(40, 10).alias("box_max"))
    df = ops.select("id", F.explode(op_chunks("action", "coord", "box_min", "box_max")).alias("c"))
    return df.select("id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"))


@query("chunks_in_radius", f"""select id, cx+dx cx, cz+dz cz from (select id, {CHUNK_SQL} from {VOXELS} v) q,
    (select -2 dx union all select -1 union all select 0 union all select 1 union all select 2) a,
    (select -2 dz union all select -1 union all select 0 union all select 1 union all select 2) b where abs(dx)+abs(dz) <= 2""")
def chunks_in_radius(t):
    from ..operators.chunks import chunks_in_manhattan

    return chunks_in_manhattan(chunk_of_voxel(t).drop("cy"), 2)


REGION_SQL = "cast(floor(lon/0.01e0) as bigint) x3, cast(floor(lat/0.01e0) as bigint) y3"


@query("region_id", """select event_id, cast(floor(lon/10e0) as bigint) x0, cast(floor(lat/10e0) as bigint) y0,
    cast(floor(lon/1e0) as bigint) x1, cast(floor(lat/1e0) as bigint) y1, cast(floor(lon/0.1e0) as bigint) x2,
    cast(floor(lat/0.1e0) as bigint) y2, cast(floor(lon/0.01e0) as bigint) x3, cast(floor(lat/0.01e0) as bigint) y3 from position""")
def region_id(t):
    cols = []
    for level in range(4):
        r = geo.region_id("lat", "lon", level)
        cols += [r["x"].alias(f"x{level}"), r["y"].alias(f"y{level}")]
    return t.position.select("event_id", *cols)


@query("region_parent", f"""select event_id, cast(floor(x3/10e0) as bigint) px, cast(floor(y3/10e0) as bigint) py
    from (select event_id, {REGION_SQL} from position) q""")
def region_parent(t):
    p = geo.region_parent(geo.region_id("lat", "lon", 3))
    return t.position.select("event_id", p["x"].alias("px"), p["y"].alias("py"))


@query("region_neighbours", f"""select distinct x3+dx nx, y3+dy ny from (select {REGION_SQL} from position) q,
    (select -1 dx union all select 0 union all select 1) a, (select -1 dy union all select 0 union all select 1) b""")
def region_neighbours(t):
    own = t.position.select(geo.region_id("lat", "lon", 3).alias("r")).distinct()
    return own.select(F.explode(geo.region_neighbours(F.col("r"))).alias("n")).select(
        F.col("n.x").alias("nx"), F.col("n.y").alias("ny")
    ).distinct()


@query("region_topic", f"select event_id, printf('state-L3-x%04d-y%04d', x3, y3) topic from (select event_id, {REGION_SQL} from position) q")
def region_topic(t):
    return t.position.select("event_id", geo.region_topic(geo.region_id("lat", "lon", 3)).alias("topic"))


@query("subscribe_topics", f"""select distinct x3, y3, printf('state-L%d-x%04d-y%04d', lv, nx, ny) topic from (
    select x3, y3, 3 lv, x3+dx nx, y3+dy ny from (select {REGION_SQL} from position) q,
      (select -1 dx union all select 0 union all select 1) a, (select -1 dy union all select 0 union all select 1) b
    union all select x3, y3, 2 lv, cast(floor(x3/10e0) as bigint)+dx nx, cast(floor(y3/10e0) as bigint)+dy ny from (select {REGION_SQL} from position) q,
      (select -1 dx union all select 0 union all select 1) a, (select -1 dy union all select 0 union all select 1) b) z""")
def subscribe_topics(t):
    own = t.position.select(geo.region_id("lat", "lon", 3).alias("r")).distinct()
    return own.select(
        F.col("r.x").alias("x3"), F.col("r.y").alias("y3"), F.explode(geo.subscribe_topics(F.col("r"))).alias("topic")
    )


# ---------------------------------------------------------------------------------------------------------
# Geometry
# ---------------------------------------------------------------------------------------------------------
BOX_SQL = "(select poly_id, min(lat) lat_min, max(lat) lat_max, min(lon) lon_min, max(lon) lon_max from poly_vertex group by poly_id)"


@query("bbox_of_geometry", f"select poly_id, round(lat_min,9) lat_min, round(lat_max,9) lat_max, round(lon_min,9) lon_min, round(lon_max,9) lon_max from {BOX_SQL} b")
def bbox_of_geometry(t):
    df = t.polygons.select("poly_id", gm.bbox_of_geometry("polygon").alias("b")).select("poly_id", "b.*")
    return rounded(df, 9, "lat_min", "lat_max", "lon_min", "lon_max")


@query("bbox_overlap", f"""select poly_id, lat_max>=-27.5e0 and lat_min<=-27.45e0 and lon_max>=153.05e0 and lon_min<=153.1e0 hit from {BOX_SQL} b""")
def bbox_overlap(t):
    box = F.struct(F.lit(-27.5).alias("lat_min"), F.lit(-27.45).alias("lat_max"), F.lit(153.05).alias("lon_min"), F.lit(153.1).alias("lon_max"))
    return t.polygons.select("poly_id", gm.bbox_overlap(gm.bbox_of_geometry("polygon"), box).alias("hit"))


@query("centroid_vertex_mean", "select poly_id, round(avg(lat),8) lat, round(avg(lon),8) lon from poly_vertex group by poly_id")
def centroid_vertex_mean(t):
    df = t.polygons.select("poly_id", gm.centroid_vertex_mean("polygon").alias("c")).select("poly_id", "c.*")
    return rounded(df, 8, "lat", "lon")


@query("tile_keys_of_bbox", f"""select poly_id, s, w from {BOX_SQL} b,
    lateral (select unnest(range(cast(floor(lat_min/0.01e0) as bigint), cast(floor(lat_max/0.01e0) as bigint)+1)) s) x,
    lateral (select unnest(range(cast(floor(lon_min/0.01e0) as bigint), cast(floor(lon_max/0.01e0) as bigint)+1)) w) y""")
def tile_keys_of_bbox(t):
    return t.polygons.select("poly_id", F.explode(gm.tile_keys_of_bbox("polygon")).alias("k")).select("poly_id", "k.s", "k.w")


EDGE_SQL = """(select poly_id, lat la, lon lo, lead(lat) over w lb, lead(lon) over w lob, seq from
    (select poly_id, lat, lon, seq from poly_vertex union all select poly_id, lat, lon, 6 seq from poly_vertex where seq=1) z
    window w as (partition by poly_id order by seq) qualify lead(lat) over w is not null)"""


def inside_sql(points: str, pid: str) -> str:
    return f"""(select p.{pid}, e.poly_id from {points} p join {EDGE_SQL} e on true
      group by p.{pid}, e.poly_id having sum(case when (e.lo > p.lon) <> (e.lob > p.lon)
      and p.lat < (e.lb-e.la)*(p.lon-e.lo)/(e.lob-e.lo)+e.la then 1 else 0 end) % 2 = 1)"""


@query("point_in_polygon", f"select event_id, poly_id from {inside_sql('position', 'event_id')} h")
def point_in_polygon(t):
    from ..operators.spatial_join import points_in_polygons

    return points_in_polygons(t.position.select("event_id", "lat", "lon"), t.polygons.select("poly_id", "polygon"), ["event_id"]).select("event_id", "poly_id")


# Water bodies: the pentagons with one hole, a quarter-size copy about the vertex mean.
HOLED = """(with m as (select poly_id, avg(lat) my, avg(lon) mx from poly_vertex group by poly_id)
   select v.poly_id, v.seq, m.my+(v.lat-m.my)*0.25e0 lat, m.mx+(v.lon-m.mx)*0.25e0 lon from poly_vertex v join m on v.poly_id=m.poly_id)"""


def water_bodies(t):
    c = gm.centroid_vertex_mean("polygon")
    hole = F.transform("polygon", lambda p: gm.point(
        F.col("_c.lat") + (p["lat"] - F.col("_c.lat")) * 0.25, F.col("_c.lon") + (p["lon"] - F.col("_c.lon")) * 0.25))
    df = t.polygons.withColumn("_c", c).withColumn("holes", F.array(hole)).drop("_c")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("lake", "reservoir", "river", "pond", "stream")]), (F.col("poly_id") % 5 + 1).cast("int"))
    return df.withColumn("water_type", kind)


@query("point_in_water", f"""select h.event_id, h.poly_id from {inside_sql('position', 'event_id')} h
    left join {inside_sql('position', 'event_id').replace('from poly_vertex union', f'from {HOLED} pv union').replace('from poly_vertex where', f'from {HOLED} pv where')} i
    on h.event_id=i.event_id and h.poly_id=i.poly_id where i.event_id is null""")
def point_in_water(t):
    from ..operators.spatial_join import points_in_polygons

    pts = t.position.select("event_id", "lat", "lon")
    return points_in_polygons(pts, water_bodies(t).select("poly_id", "polygon", "holes"), ["event_id"], holes="holes").select("event_id", "poly_id")


SEG_SQL = """(select line_id, seq-1 seg, lat a_lat, lon a_lon, elev a_elev, lead(lat) over w b_lat, lead(lon) over w b_lon, lead(elev) over w b_elev
    from line_vertex window w as (partition by line_id order by seq) qualify lead(lat) over w is not null)"""


def dist_t_sql(lat="lat", lon="lon", floor_cos=False) -> str:
    """``dist_m`` and ``t`` to the segment a-b, given as columns a_lat, a_lon, b_lat, b_lon."""
    cos = f"greatest(abs(cos(radians({lat}))),0.1e0)" if floor_cos else f"cos(radians({lat}))"
    px, pz = f"(({lat})-a_lat)*111320e0", f"(({lon})-a_lon)*111320e0*{cos}"
    dx, dz = "(b_lat-a_lat)*111320e0", f"(b_lon-a_lon)*111320e0*{cos}"
    len2 = f"({dx}*{dx}+{dz}*{dz})"
    t = f"(case when {len2}<1e-10 then 0e0 else least(greatest(({px}*{dx}+{pz}*{dz})/{len2},0e0),1e0) end)"
    return f"sqrt(power({dx}*{t}-{px},2e0)+power({dz}*{t}-{pz},2e0)) dist_m, {t} t"


@query("point_segment_distance_m", f"""select line_id, seg, round(dist_m,5) dist_m, round(t,8) t, round(a_lat+t*(b_lat-a_lat),8) c_lat,
    round(a_lon+t*(b_lon-a_lon),8) c_lon from (select s.*, {dist_t_sql('a_lat+0.0007e0', 'a_lon-0.0003e0')} from {SEG_SQL} s) q""")
def point_segment_distance_m(t):
    from ..operators.spatial_join import explode_segments

    s = explode_segments(t.lines)
    hit = gm.point_segment_distance_m(F.col("a.lat") + 0.0007, F.col("a.lon") - 0.0003, "a.lat", "a.lon", "b.lat", "b.lon")
    df = s.select("line_id", "seg", hit.alias("h"))
    return df.select("line_id", "seg", F.round("h.dist_m", 5).alias("dist_m"), F.round("h.t", 8).alias("t"),
                     F.round("h.lat", 8).alias("c_lat"), F.round("h.lon", 8).alias("c_lon"))


@query("point_polyline_distance_m", f"""select line_id, round(min(dist_m),5) dist_m from (select s.line_id, {dist_t_sql('p.lat', 'p.lon', True)}
    from {SEG_SQL} s join site p on p.site_id=s.line_id) q group by line_id""")
def point_polyline_distance_m(t):
    df = t.lines.join(t.site.select(F.col("site_id").alias("line_id"), "lat", "lon"), "line_id")
    return df.select("line_id", F.round(gm.point_polyline_distance_m("lat", "lon", "line"), 5).alias("dist_m"))


@query("near_polyline_deg", f"""select line_id, bool_or(power(a_lat+t*(b_lat-a_lat)-y,2e0)+power(a_lon+t*(b_lon-a_lon)-x,2e0) <= 0.002e0*0.002e0) near from
    (select *, case when l2<1e-14 then 0e0 else least(greatest(((y-a_lat)*(b_lat-a_lat)+(x-a_lon)*(b_lon-a_lon))/l2,0e0),1e0) end t from
    (select s.*, p.lat+0.0011e0 y, p.lon-0.0012e0 x, power(b_lat-a_lat,2e0)+power(b_lon-a_lon,2e0) l2 from {SEG_SQL} s join site p on p.site_id=s.line_id) q) z group by line_id""")
def near_polyline_deg(t):
    df = t.lines.join(t.site.select(F.col("site_id").alias("line_id"), "lat", "lon"), "line_id")
    return df.select("line_id", gm.near_polyline_deg(F.col("lat") + 0.0011, F.col("lon") - 0.0012, "line").alias("near"))


def orient_sql(a, b, c):
    return f"(({b}_lon-{a}_lon)*({c}_lat-{a}_lat)-({b}_lat-{a}_lat)*({c}_lon-{a}_lon))"


def crossing_sql(a0="a", a1="b", b0="c", b1="d") -> str:
    """Whether segments a0-a1 and b0-b1 meet."""
    o = [orient_sql(a0, a1, b0), orient_sql(a0, a1, b1), orient_sql(b0, b1, a0), orient_sql(b0, b1, a1)]

    def on(p, q, r):
        return (f"({r}_lon >= least({p}_lon,{q}_lon)-1e-12 and {r}_lon <= greatest({p}_lon,{q}_lon)+1e-12 and "
                f"{r}_lat >= least({p}_lat,{q}_lat)-1e-12 and {r}_lat <= greatest({p}_lat,{q}_lat)+1e-12)")

    def split(x, y):
        return f"(({x}>1e-12 and {y}<-1e-12) or ({x}<-1e-12 and {y}>1e-12))"

    return (f"(({split(o[0], o[1])} and {split(o[2], o[3])}) or (abs({o[0]})<=1e-12 and {on(a0, a1, b0)}) or (abs({o[1]})<=1e-12 and {on(a0, a1, b1)})"
            f" or (abs({o[2]})<=1e-12 and {on(b0, b1, a0)}) or (abs({o[3]})<=1e-12 and {on(b0, b1, a1)}))")


@query("segments_intersect", f"""select line_id, seg, {crossing_sql()} hit from (select *, a_lat+0.0016e0 c_lat, a_lon-0.001e0 c_lon,
    a_lat+0.0011e0 d_lat, a_lon+0.0021e0 d_lon from {SEG_SQL} s) q""")
def segments_intersect(t):
    from ..operators.spatial_join import explode_segments

    s = explode_segments(t.lines)
    c = gm.point(F.col("a.lat") + 0.0016, F.col("a.lon") - 0.001)
    d = gm.point(F.col("a.lat") + 0.0011, F.col("a.lon") + 0.0021)
    return s.select("line_id", "seg", gm.segments_intersect(F.col("a"), F.col("b"), c, d).alias("hit"))


@query("polyline_at_t", """select line_id, round(lo + (hi-lo)*(fi-floor(fi)),6) water_m from (select p.site_id line_id, fi,
    max(case when v.seq = floor(fi)+1 then elev end) lo, max(case when v.seq = least(floor(fi)+2,4) then elev end) hi
    from (select site_id, least(greatest((site_id % 11)/10e0*3e0,0e0),3e0) fi from site) p join line_vertex v on v.line_id=p.site_id group by p.site_id, fi) q""")
def polyline_at_t(t):
    elev = t.line_vertex.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", "elev"))).alias("e"))
    elev = elev.select("line_id", F.transform("e", lambda x: x["elev"]).alias("e"))
    return elev.select("line_id", F.round(gm.lerp_at("e", (F.col("line_id") % 11) / 10.0), 6).alias("water_m"))


# ---------------------------------------------------------------------------------------------------------
# Classification
# ---------------------------------------------------------------------------------------------------------
def case_sql(column: str, table: dict, default: str | None = None, pick=lambda v: v) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}"

    arms = " ".join(f"when '{k}' then {lit(pick(v))}" for k, v in table.items() if pick(v) is not None)
    tail = f" else {default}" if default is not None else ""
    return f"(case {column} {arms}{tail} end)"


CLIMATE_SQL = "(case " + " ".join(f"when b <= {top} then '{name}'" for top, name in rules.CLIMATE_BANDS) + " else 'IceCap' end)"
CLIMATE_SRC = f"(select *, {CLIMATE_SQL} climate from (select *, floor(greatest(abs(lat)+elev/150e0,0e0)) b from {GLOBE} g) q)"


@query("climate_zone", f"select id, climate from {CLIMATE_SRC} c")
def climate_zone(t):
    return globe(t).select("id", rules.climate_zone("lat", "elev").alias("climate"))


# Metrics spread over all branches.
METRICS = f"""(select id, lat, climate, elev*12e0-200e0 elev, (id % 71)*1e0 slope, (id % 17)*1e0 twi, (id % 53)*1e0 tri,
   (id % 23)*100e0 coast_m, case id % 13 when 0 then 'Residential' when 1 then 'Farmland' when 2 then 'Water' when 3 then 'Forest' end landuse from {CLIMATE_SRC} c)"""


def metrics(t):
    df = globe(t).withColumn("climate", rules.climate_zone("lat", "elev"))
    return df.select("id", "lat", "climate", (F.col("elev") * 12.0 - 200.0).alias("elev"), (F.col("id") % 71).cast("double").alias("slope"),
                     (F.col("id") % 17).cast("double").alias("twi"), (F.col("id") % 53).cast("double").alias("tri"),
                     ((F.col("id") % 23) * 100.0).alias("coast_m"),
                     F.when(F.col("id") % 13 == 0, "Residential").when(F.col("id") % 13 == 1, "Farmland")
                     .when(F.col("id") % 13 == 2, "Water").when(F.col("id") % 13 == 3, "Forest").alias("landuse"))


TROPIC = "('TropicalRainforest','TropicalMonsoon','TropicalSavanna')"
TREELINE_SQL = """(case when climate in ('TropicalRainforest','TropicalMonsoon') then 3500e0 when climate='HumidSubtropical' then 1800e0
   when climate in ('OceanicMaritime','HumidContinental') then 1200e0 when climate='SubarcticBoreal' then 600e0 when climate in ('Tundra','IceCap') then 0e0 else 2000e0 end)"""
BIOME_SQL = f"""(case when landuse in ('Residential','Commercial','Industrial','Retail') then 'Urban' when landuse in ('Farmland','Meadow') then 'Agricultural'
   when landuse='Water' then 'Lake' when elev<0 then 'Ocean' when coast_m<500 and slope>20 then 'RockyCoast' when coast_m<500 and twi>10 then 'MangroveCoast'
   when coast_m<500 then 'Beach' when twi>14 then 'Wetland' when twi>10 and slope<5 then 'RiparianCorridor' when elev>{TREELINE_SQL}+500 then 'IceCap'
   when elev>{TREELINE_SQL} then 'AlpineGrassland' when climate in {TROPIC} then case when elev>800 then 'MontaneForest' else 'SubtropicalForest' end
   when climate='HumidSubtropical' then case when elev>600 then 'DrySclerophyllForest' when twi>7 then 'SubtropicalForest' else 'SubtropicalGrassland' end
   when climate in ('MediterraneanHot','MediterraneanWarm') then case when twi>7 then 'SubtropicalForest' else 'Shrubland' end
   when climate in ('OceanicMaritime','HumidContinental') then 'SubtropicalForest' when climate='SubarcticBoreal' then 'BorealForest'
   when climate='Tundra' then 'Tundra' else 'IceCap' end)"""
SUBSTRATE_SQL = f"""(case when biome='Urban' then 'UrbanFill' when biome in ('Ocean','Lake') then 'Sand' when biome='Wetland' then 'Peat' when biome='Beach' then 'Sand'
   when biome='MangroveCoast' then 'Silty' when slope>50 and tri>40 then 'BedRock'
   when biome in ('RiparianCorridor','River') then case when floor(slope)<=1 then 'Silty' when floor(slope)<=4 then 'GreyClay' else 'GravelBed' end
   when biome in ('IceCap','Tundra') then 'Permafrost' when climate in {TROPIC} then 'TropicalRed'
   when climate='HumidSubtropical' then case when elev>400 then 'Sandstone' when twi>8 then 'GreyClay' else 'RedClay' end
   when climate in ('MediterraneanHot','MediterraneanWarm') then 'Sandstone' else 'TemperateBrown' end)"""
BIOME_SRC = f"(select *, {BIOME_SQL} biome from {METRICS} m)"
SUBSTRATE_SRC = f"(select *, {SUBSTRATE_SQL} substrate from {BIOME_SRC} b)"


def with_biome(t):
    return metrics(t).withColumn("biome", rules.biome("elev", "slope", "twi", "coast_m", "landuse", "climate"))


def with_substrate(t):
    return with_biome(t).withColumn("substrate", rules.substrate("biome", "climate", "slope", "twi", "tri", "elev"))


@query("biome", f"select id, biome from {BIOME_SRC} b")
def biome(t):
    return with_biome(t).select("id", "biome")


@query("substrate", f"select id, substrate from {SUBSTRATE_SRC} b")
def substrate(t):
    return with_substrate(t).select("id", "substrate")


SOIL_SQL = case_sql("substrate", rules.SOIL_DEPTH)


@query("classify_column", f"""select id, climate, biome, substrate, cast({SOIL_SQL} as bigint) soil_depth, substrate='UrbanFill' sealed from (
    select *, {SUBSTRATE_SQL} substrate from (select id, climate, elev, slope, twi, tri, case when ocean and elev<=5 and landuse is distinct from 'Water' then 'Ocean'
    else {BIOME_SQL} end biome from (select id, elev, coalesce(slope,5e0) slope, coalesce(twi,7e0) twi, coalesce(tri,5e0) tri, coalesce(coast_m,100000e0) coast_m, landuse, ocean,
      {CLIMATE_SQL} climate from (select id, elev, landuse, id % 7=0 ocean, nullif(slope,3e0) slope, nullif(twi,4e0) twi, nullif(tri,5e0) tri, nullif(coast_m,600e0) coast_m,
      floor(greatest(abs(lat)+elev/150e0,0e0)) b from {METRICS} m) q0) q1) q2) q3""")
def classify_column(t):
    df = metrics(t).drop("climate").withColumn("ocean", F.col("id") % 7 == 0)
    for c, v in (("slope", 3.0), ("twi", 4.0), ("tri", 5.0), ("coast_m", 600.0)):
        df = df.withColumn(c, F.nullif(F.col(c), F.lit(v)))
    out = rules.classify_column(df, elev="elev", slope="slope")
    return out.select("id", "climate", "biome", "substrate", "soil_depth", "sealed")


@query("moisture_class", f"select id, case when twi>12 then 'Waterlogged' when twi>8 then 'Wet' when twi>5 then 'Moderate' else 'Dry' end moisture from {METRICS} m")
def moisture_class(t):
    return metrics(t).select("id", rules.moisture_class("twi").alias("moisture"))


@query("likely_river", f"select id, coast_m>500 and slope<15 river from {METRICS} m")
def likely_river(t):
    return metrics(t).select("id", rules.likely_river("coast_m", "slope").alias("river"))


@query("likely_cliff", f"select id, slope>45 and tri>20 cliff from {METRICS} m")
def likely_cliff(t):
    return metrics(t).select("id", rules.likely_cliff("slope", "tri").alias("cliff"))


BASE_SQL = """(case when biome in ('Ocean','Lake','River') then 'WATER' when biome='Beach' then 'SAND' when biome in ('Wetland','RiparianCorridor','MangroveCoast','BorealForest') then 'GRASS'
   when biome='Urban' then 'ASPHALT' when biome in ('Agricultural','DrySclerophyllForest','SubtropicalGrassland','Shrubland','Desert') then 'GRASS_DRY'
   when biome in ('AlpineGrassland','Tundra','IceCap') then 'SNOW' when substrate in ('BedRock','Sandstone','Granite','Basalt') then 'STONE' when substrate='Sand' then 'SAND'
   when substrate='UrbanFill' then 'ASPHALT' when substrate in ('RedClay','TropicalRed') then 'LATERITE' else 'GRASS' end)"""


@query("surface_materials", f"""select id, case when slope>65 then 'STONE' when slope>45 then case when base in ('STONE','SAND') then base else 'DIRT' end
    when slope>25 and base='GRASS' then 'DIRT' else base end surface,
    case when substrate='Sand' then 'SAND' when substrate='UrbanFill' then 'CONCRETE' when substrate in ('BedRock','Sandstone','Granite','Basalt') then 'STONE'
      when substrate in ('RedClay','TropicalRed') then 'LATERITE' else 'DIRT' end subsurface,
    cast(case when slope>65 then 1 when slope>45 then greatest(soil//2,1) else soil end as bigint) soil from (select *, {BASE_SQL} base, {SOIL_SQL} soil from {SUBSTRATE_SRC} s) q""")
def surface_materials(t):
    df = with_substrate(t).withColumn("depth", rules.lookup("substrate", rules.SOIL_DEPTH))
    return df.select("id", rules.surface_materials("biome", "substrate", "depth", "slope").alias("m")).select("id", "m.*")


BY_NAME = {v[0]: v for v in rules.MATERIALS.values()}


@query("material_properties", f"""select op_id, {case_sql('material', BY_NAME, pick=lambda v: v[1])} solid, {case_sql('material', BY_NAME, pick=lambda v: v[2])} transparent,
    cast({case_sql('material', BY_NAME, pick=lambda v: v[3])} as double) density, cast({case_sql('material', BY_NAME, pick=lambda v: v[4])} as bigint) red,
    cast({case_sql('material', BY_NAME, pick=lambda v: v[5])} as bigint) green, cast({case_sql('material', BY_NAME, pick=lambda v: v[6])} as bigint) blue from op_log""")
def material_properties(t):
    return rules.material_properties(t.op_log.select("op_id", "material")).drop("material")


ROAD_SRC = f"(select way_id, status, highway, {case_sql('highway', rules.ROAD_CLASS, chr(39) + 'Other' + chr(39))} cls from way_tag)"


@query("road_class", f"select way_id, cls from {ROAD_SRC} r")
def road_class(t):
    return t.way_tag.select("way_id", rules.road_class("highway").alias("cls"))


def _roads(t):
    return t.way_tag.withColumn("cls", rules.road_class("highway"))


@query("road_width_m", f"select way_id, cast({case_sql('cls', rules.ROAD_ATTRS, pick=lambda v: v[0])} as double) width_m from {ROAD_SRC} r")
def road_width_m(t):
    return _roads(t).select("way_id", rules.road_width_m("cls").alias("width_m"))


@query("road_paved", f"select way_id, {case_sql('cls', rules.ROAD_ATTRS, pick=lambda v: v[1])} paved from {ROAD_SRC} r")
def road_paved(t):
    return _roads(t).select("way_id", rules.road_paved("cls").alias("paved"))


@query("footpath_width_m", f"select way_id, cast({case_sql('cls', rules.ROAD_ATTRS, pick=lambda v: v[2])} as double) footpath_m from {ROAD_SRC} r")
def footpath_width_m(t):
    return _roads(t).select("way_id", rules.footpath_width_m("cls").alias("footpath_m"))


@query("road_material", f"select way_id, {case_sql('cls', rules.ROAD_ATTRS, pick=lambda v: v[3])} material from {ROAD_SRC} r")
def road_material(t):
    return _roads(t).select("way_id", rules.road_material("cls").alias("material"))


WATER_KIND = "(case o_orderkey % 6 when 0 then 'river' when 1 then 'canal' when 2 then 'stream' when 3 then 'drain' when 4 then 'ditch' else 'tidal' end)"


@query("waterway_defaults", f"""select id, cast({case_sql('kind', rules.WATERWAY, '1.5', lambda v: v[0])} as double) half_width_m,
    cast({case_sql('kind', rules.WATERWAY, '2', lambda v: v[1])} as bigint) depth_vox, cast({case_sql('kind', rules.WATERWAY, '1.0', lambda v: v[2])} as double) base_half_width_m,
    cast({case_sql('kind', rules.WATERWAY, '0.5', lambda v: v[3])} as double) base_depth_m from (select o_orderkey id, {WATER_KIND} kind from orders) q""")
def waterway_defaults(t):
    df = t.sql(f"select o_orderkey id, {WATER_KIND} kind from orders")
    return df.select("id", rules.waterway_defaults("kind").alias("w")).select("id", "w.*")


@query("building_height", """select p_partkey id, case p_size % 4 when 0 then p_size*1.5e0 when 1 then p_size*3e0 when 2 then p_size*0.5e0 else 6e0 end height_m from part""")
def building_height(t):
    size = F.col("p_size")
    tags = (
        F.when(size % 4 == 0, F.create_map(F.lit("height"), F.concat((size * 1.5).cast("string"), F.lit(" m"))))
        .when(size % 4 == 1, F.create_map(F.lit("height"), F.lit("tall"), F.lit("building:levels"), size.cast("string")))
        .when(size % 4 == 2, F.create_map(F.lit("height"), (size * 0.5).cast("string")))
        .otherwise(F.create_map(F.lit("building"), F.lit("yes")))
    )
    return t.part.select(F.col("p_partkey").alias("id"), rules.building_height(tags).alias("height_m"))


AREA_TYPES = ["residential", "wood", "orchard", "grass", "park", "pitch", "runway", "recreation_ground", "aerodrome", "retail", "helipad"]
AREA_TYPE_SQL = "(case {k} % 11 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(AREA_TYPES)) + " end)"


def area_type(key):
    return F.element_at(F.array(*[F.lit(a) for a in AREA_TYPES]), (key % len(AREA_TYPES) + 1).cast("int"))


AREA_SRC = f"(select p_partkey id, {AREA_TYPE_SQL.format(k='p_partkey')} area_type from part)"


@query("landuse_class", f"select id, {case_sql('area_type', rules.LANDUSE_CLASS)} cls from {AREA_SRC} a")
def landuse_class(t):
    return t.part.select(F.col("p_partkey").alias("id"), rules.landuse_class(area_type(F.col("p_partkey"))).alias("cls"))


@query("landuse_priority", f"select id, cast({case_sql('cls', rules.LANDUSE_PRIORITY)} as bigint) priority from (select id, {case_sql('area_type', rules.LANDUSE_CLASS)} cls from {AREA_SRC} a) q")
def landuse_priority(t):
    return landuse_class(t).select("id", rules.landuse_priority("cls").alias("priority"))


@query("ground_profile", "select id, " + ", ".join(
    f"cast({case_sql('area_type', rules.GROUND_PROFILE, pick=lambda v, i=i: v[i])} as {'bigint' if i == 0 else 'varchar' if i == 3 else 'boolean' if i == 4 else 'double'}) {f}"
    for i, f in enumerate(rules.GROUND_FIELDS)) + f" from {AREA_SRC} a")
def ground_profile(t):
    df = t.part.select(F.col("p_partkey").alias("id"), rules.ground_profile(area_type(F.col("p_partkey"))).alias("g")).select("id", "g.*")
    return df.withColumn("priority", big(F.col("priority")))


AMENITY_SQL = "(case id % 7 when 0 then 'bench' when 1 then 'waste_basket' when 2 then 'recycling' when 3 then 'post_box' when 4 then 'traffic_signals' when 5 then 'cafe' end)"


@query("amenity_model", f"select id, {case_sql('amenity', rules.AMENITY_MODEL)} model from (select id, {AMENITY_SQL} amenity from (select p_partkey id from part) p) q")
def amenity_model(t):
    df = t.sql(f"select id, {AMENITY_SQL} amenity from (select p_partkey id from part) p")
    return df.select("id", rules.amenity_model("amenity").alias("model"))


@query("node_model", "select p_partkey id, case p_partkey % 5 when 0 then 'streetlight' when 1 then 'traffic_light' when 2 then 'traffic_light' when 3 then 'streetlight' end model from part")
def node_model(t):
    k = F.col("p_partkey") % 5
    tags = (
        F.when(k == 0, F.create_map(F.lit("highway"), F.lit("street_lamp")))
        .when(k == 1, F.create_map(F.lit("highway"), F.lit("traffic_signals")))
        .when(k == 2, F.create_map(F.lit("amenity"), F.lit("traffic_signals")))
        .when(k == 3, F.create_map(F.lit("power"), F.lit("pole")))
        .otherwise(F.create_map(F.lit("power"), F.lit("tower")))
    )
    return t.part.select(F.col("p_partkey").alias("id"), rules.node_model(tags).alias("model"))


@query("engineered_height", """select id, round(case when s<=0.05e0 then z else z+(50e0-z)*s end,6) z from
    (select o_orderkey id, o_totalprice/1000e0 z, least(greatest((o_orderkey % 27)/23e0-0.1e0,0e0),1e0) s from orders) q""")
def engineered_height(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000.0).alias("z"))
    return df.select("id", F.round(rules.engineered_height("z", F.lit(50.0), (F.col("id") % 27) / 23.0 - 0.1), 6).alias("z"))


@query("ortho_to_voxel_y", f"""select id, cast(trunc(elev+{GEOID_SQL}-35.3e0) as bigint)+6400100 vy from (select *, fmod(lon+360e0,360e0) l from {GLOBE} g) q""")
def ortho_to_voxel_y(t):
    return globe(t).select("id", rules.ortho_to_voxel_y("elev", "lat", "lon", F.lit(35.3), F.lit(6400100)).alias("vy"))


# ---------------------------------------------------------------------------------------------------------
# Strings, hashes, maps, clocks
# ---------------------------------------------------------------------------------------------------------
@query("content_id", "select conv_id, turn, sha256(role||chr(0)||cast(turn as varchar)||chr(0)||text||chr(0)||cast(conv_id as varchar)||chr(0)||cast(turn*1000 as varchar)) id from conversations")
def content_id(t):
    from ..operators.directory import content_id

    return t.conversations.select(
        "conv_id", "turn", content_id("role", F.col("turn").cast("string"), "text", F.col("conv_id").cast("string"), F.col("turn") * 1000).alias("id")
    )


@query("op_id", "select doc_id, left(sha256(text),32) op_id from documents")
def op_id(t):
    from ..operators.oplog import op_id

    signature = F.sha2("text", 256)
    return t.documents.select("doc_id", op_id(signature).alias("op_id"))


@query("stable_object_id", """select site_id, 'inf_'||left(sha256('bench|'||cast(cast(round(lat*1e6) as bigint) as varchar)||'|'||cast(cast(round(lon*1e6) as bigint) as varchar)),16) object_id from site""")
def stable_object_id(t):
    from ..operators.inference import stable_object_id

    return t.site.select("site_id", stable_object_id(F.lit("bench"), "lat", "lon").alias("object_id"))


@query("synthetic_member_id", "select way_id, seq, -cast('0x'||substr(md5(cast(way_id as varchar)||':'||cast(seq as varchar)),1,15) as bigint)-1 member_id from way_node")
def synthetic_member_id(t):
    from ..operators.inference import synthetic_member_id

    return t.way_node.select("way_id", "seq", synthetic_member_id("way_id", "seq").alias("member_id"))


def way_tags(t):
    """Ways of ``way_tag`` with their tags as a map."""
    bridge = F.when(F.col("status") == "O", F.create_map(F.lit("bridge"), F.lit("yes"), F.lit("layer"), (F.col("way_id") % 4).cast("string")))
    tunnel = F.when(F.col("status") == "P", F.create_map(F.lit("tunnel"), F.lit("yes"), F.lit("layer"), F.lit("deep")))
    extra = F.coalesce(bridge, tunnel, F.create_map(F.lit("name"), F.concat(F.lit("w"), F.col("way_id").cast("string"))))
    return t.way_tag.select("way_id", "highway", "status", F.map_concat(F.create_map(F.lit("highway"), F.col("highway")), extra).alias("tags"))


@query("tag_get", "select way_id, highway, case when status='O' then 'yes' end bridge from way_tag")
def tag_get(t):
    return way_tags(t).select("way_id", rules.tag_get("tags", "highway").alias("highway"), rules.tag_get("tags", "bridge").alias("bridge"))


@query("has_tag", "select way_id, status='P' tunnel from way_tag")
def has_tag(t):
    return way_tags(t).select("way_id", rules.has_tag("tags", "tunnel").alias("tunnel"))


@query("by_tag", "select way_id from way_tag where highway='primary'")
def by_tag(t):
    return way_tags(t).where(rules.has_tag("tags", "highway", "primary")).select("way_id")


@query("way_attributes", """select way_id, case when status not in ('O','P') then 'w'||cast(way_id as varchar) end as name, status='O' is_bridge, status='P' is_tunnel,
    cast(case when status='O' then way_id % 4 else 0 end as bigint) layer, 'water' water_type from way_tag""")
def way_attributes(t):
    return way_tags(t).select("way_id", rules.way_attributes("tags").alias("a")).select("way_id", "a.*")


ROUTES = """(select page_id, case page_id % 9 when 0 then 'worldnet://' when 1 then 'worldnet://forums' when 2 then 'worldnet://forums/thread/'||cast(page_id as string)
   when 3 then 'worldnet://wiki/page'||cast(page_id as string) when 4 then 'worldnet://settings/identity' when 5 then 'worldnet://admin/keys'
   when 6 then 'worldnet://world/chunk/3/'||cast(page_id as string) when 7 then 'user/'||cast(page_id as string) else 'worldnet://shop/cart' end address from pages)"""


@query("address_route", f"""select page_id, case page_id % 9 when 0 then 'Root' when 1 then 'Forums' when 2 then 'ForumThread' when 3 then 'WikiPage' when 4 then 'SettingsIdentity'
    when 5 then 'AdminKeys' when 6 then 'WorldChunk' when 7 then 'UserProfile' else 'Custom' end route, case page_id % 9 when 4 then 'Guest' when 5 then 'Admin' when 7 then 'Guest' end required from pages""")
def address_route(t):
    from ..operators.directory import address_route, address_required

    df = t.sql(f"select * from {ROUTES} r").withColumn("route", address_route("address"))
    return df.select("page_id", "route", address_required("route").alias("required"))


@query("address_access", f"""select page_id, tier from (select page_id, page_id % 9 k from pages) p, (select 'User' tier union all select 'Admin' union all select 'None') v
    where k not in (4,5,7) or (k in (4,7) and tier<>'None') or (k=5 and tier='Admin')""")
def address_access(t):
    from ..operators.directory import address_access, address_route

    df = t.sql(f"select * from {ROUTES} r").withColumn("tier", F.explode(F.array(F.lit("User"), F.lit("Admin"), F.lit("None"))))
    return df.where(address_access(address_route("address"), "tier")).select("page_id", "tier")


CLOCKS = "(select o_orderkey id, o_orderkey % 4 a1, o_custkey % 4 b1, o_orderkey % 3 a2, o_custkey % 3 b2 from orders)"


def _clocks(t):
    df = t.sql(f"select * from {CLOCKS} c")

    def clock(x, y):
        return F.map_filter(F.create_map(F.lit("A"), big(F.col(x)), F.lit("B"), big(F.col(y))), lambda k, v: v > 0)

    return df.select("id", clock("a1", "b1").alias("c1"), clock("a2", "b2").alias("c2"))


@query("clock_get", f"select id, cast(a1 as bigint) a, cast(b2 as bigint) b from {CLOCKS} c")
def clock_get(t):
    return _clocks(t).select("id", clocks.clock_get("c1", F.lit("A")).alias("a"), clocks.clock_get("c2", F.lit("B")).alias("b"))


@query("clock_merge", f"select id, cast(greatest(a1,a2) as bigint) a, cast(greatest(b1,b2) as bigint) b from {CLOCKS} c")
def clock_merge(t):
    df = _clocks(t).select("id", clocks.clock_merge("c1", "c2").alias("m"))
    return df.select("id", clocks.clock_get("m", F.lit("A")).alias("a"), clocks.clock_get("m", F.lit("B")).alias("b"))


@query("clock_compare", f"""select id, case when a1=a2 and b1=b2 then 'equal' when a1<=a2 and b1<=b2 then 'before' when a1>=a2 and b1>=b2 then 'after' else 'concurrent' end rel from {CLOCKS} c""")
def clock_compare(t):
    return _clocks(t).select("id", clocks.clock_compare("c1", "c2").alias("rel"))


@query("key_expired", "select seq, updated_at < timestamp '1998-01-01 00:00:00' expired from key_record")
def key_expired(t):
    from ..operators.directory import key_expired

    return t.key_record.select("seq", key_expired("updated_at", F.lit("1998-01-01").cast("timestamp")).alias("expired"))


@query("effective_key_type", "select seq, case when revoked or updated_at < timestamp '1998-01-01 00:00:00' then 'Guest' else key_type end tier from key_record")
def effective_key_type(t):
    from ..operators.directory import effective_key_type

    return t.key_record.select("seq", effective_key_type("key_type", "updated_at", "revoked", F.lit("1998-01-01").cast("timestamp")).alias("tier"))


@query("angle_lerp", f"""select event_id, round(a+(d-{2 * PI!r}*floor((d+{PI!r})/{2 * PI!r}))*0.3e0,6) yaw from
    (select event_id, (event_id % 63)*0.1e0-3.1e0 a, (user_id % 59)*0.1e0-2.9e0-((event_id % 63)*0.1e0-3.1e0) d from events) q""")
def angle_lerp(t):
    df = t.sql("select event_id, (event_id % 63)*0.1e0-3.1e0 a, (user_id % 59)*0.1e0-2.9e0 b from events")
    return df.select("event_id", F.round(geo.angle_lerp("a", "b", F.lit(0.3)), 6).alias("yaw"))
