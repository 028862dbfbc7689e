"""Queries for the per-column passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import geo
from ..functions.geo import big
from ..operators import aggregates as ag, chunks as ck, columns as co, elevation as el, hydrology as hy, roads as rd
from ..operators.spatial_join import Grid
from ..session import shared_dir
from ..sources import sinks
from . import region_bake as rb
from .catalog import query
from .rasters import CENTRE, NAMES, near_sql
from .scalars import GEOID_SQL, case_sql, dist_t_sql, inside_sql, water_bodies

# Columns from the height cells: one per cell, in chunks of 30 x 30, a third of a metre of height per unit.
COLS = """(select cast(floor(c/30e0) as bigint) cx, cast(floor(r/30e0) as bigint) cz, c vx, r vz, -27.56e0+r*0.0008e0 lat, 153.02e0+c*0.0008e0 lon, z/3e0 z, cast(floor(z/3e0) as bigint) terrain_y from dem_cell)"""
SMOOTH = """(select cast(floor(c/30e0) as bigint) cx, cast(floor(r/30e0) as bigint) cz, c vx, r vz, -27.56e0+r*0.0008e0 lat, 153.02e0+c*0.0008e0 lon, z/30e0 z, 100+cast(floor(z/30e0) as bigint) terrain_y from dem_cell)"""
ORIGIN = rb.Origin(20.0, 100, -5000000.0)


def cols(t, src=COLS):
    return t.sql(f"select * from {src} c")


@query("enumerate_chunks", f"""with r as (select cast(category as varchar) region, min(lat) lat0, min(lat)+0.01e0 lat1, min(lon) lon0, min(lon)+0.01e0 lon1, min(alt)/100 z0, max(alt)/100 z1 from site group by category),
   k as (select r.*, radians(unnest([lat0,lat1])) la from r), k2 as (select k.*, radians(unnest([lon0,lon1])) lo from k), k3 as (select k2.*, unnest(case when abs(z1-z0)<2.3e-16 then [20e0] else [z0,20e0,z1] end) h from k2),
   n as (select *, {geo.WGS84_A!r}/sqrt(1-{geo._E2!r}*sin(la)*sin(la)) n from k3), v as (select region, z0, z1, floor(((n+h)*cos(la)*cos(lo)+{geo.WORLD_OFFSET_M!r})/30e0) x, floor((floor((n*(1-{geo._E2!r})+h)*sin(la)+{geo.WORLD_OFFSET_M!r}))/30e0) z from n),
   s as (select region, min(x) x0, max(x) x1, min(z) cz0, max(z) cz1, min(floor(floor(6400000+z0-20)/200e0))-1 y0, max(floor(ceil(6400000+z1-20)/200e0))+1 y1 from v group by region)
   select region, cast((x1-x0+1)*(cz1-cz0+1)*(y1-y0+1) as bigint) n, cast(x0 as bigint) cx0, cast(cz1 as bigint) cz1, cast(y0 as bigint) cy0, cast(y1 as bigint) cy1 from s""")
def enumerate_chunks(t):
    reg = t.site.groupBy(F.col("category").cast("string").alias("region")).agg(
        F.min("lat").alias("lat_min"), (F.min("lat") + 0.01).alias("lat_max"), F.min("lon").alias("lon_min"), (F.min("lon") + 0.01).alias("lon_max"),
        (F.min("alt") / 100).alias("z_min"), (F.max("alt") / 100).alias("z_max"))
    reg = reg.withColumn("origin_alt", F.lit(20.0)).withColumn("origin_vy", F.lit(6400000))
    return ck.enumerate_chunks(reg, 1).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("cx").alias("cx0"), F.max("cz").alias("cz1"), F.min("cy").alias("cy0"), F.max("cy").alias("cy1"))


@query("chunks_in_ball", """select id, cx, cy, cz, round(d,6) dist_m from (select v.id, cx, cy, cz, sqrt(power(cx*30e0+15-v.vx,2e0)+power(cy*200e0+100-v.vy,2e0)+power(cz*30e0+15-v.vz,2e0)) d from (select s_suppkey id, s_suppkey*7 % 500 vx, s_suppkey*3 % 100 vy, s_suppkey*11 % 400 vz from supplier) v,
   range(-3,20) x(cx), range(-2,3) y(cy), range(-3,17) z(cz)) q where d<=70""")
def chunks_in_ball(t):
    v = t.sql("select s_suppkey id, s_suppkey*7 % 500 vx, s_suppkey*3 % 100 vy, s_suppkey*11 % 400 vz from supplier")
    out = ck.chunks_in_radius(v, 70.0)
    return out.select("id", "cx", "cy", "cz", F.round("dist_m", 6).alias("dist_m"))


@query("nearest_chunks", """select viewer, cx, cz, rank from (select viewer, cx, cz, row_number() over (partition by viewer order by d, cx, cz) rank from (select s_suppkey viewer, s_suppkey % 20+dx cx, s_nationkey+dz cz, abs(dx)+abs(dz) d from supplier, range(-2,3) a(dx), range(-2,3) b(dz)
   where abs(dx)+abs(dz)<=2) q where (viewer+cx*3+cz) % 4<>0) z""")
def nearest_chunks(t):
    base = t.supplier.select(F.col("s_suppkey").alias("viewer"), (F.col("s_suppkey") % 20).alias("x0"), F.col("s_nationkey").cast("bigint").alias("z0"))
    want = ck.chunks_in_manhattan(base.withColumn("cx", F.col("x0")).withColumn("cz", F.col("z0")), 2).withColumn("cy", F.lit(0))
    want = want.withColumn("dist_m", F.abs(F.col("cx") - F.col("x0")) + F.abs(F.col("cz") - F.col("z0"))).drop("x0", "z0")
    loaded = want.where((F.col("viewer") + F.col("cx") * 3 + F.col("cz")) % 4 == 0)
    return ck.nearest_chunks(want, loaded).select("viewer", "cx", "cz", "rank")


@query("terrain_columns", f"""select vx, vz, cast(trunc(z+{GEOID_SQL}-20e0) as bigint)+100 surface_y, round(z+{GEOID_SQL}-20e0+100,6) surface_y_f from (select *, lon l from {COLS} c) q""")
def terrain_columns(t):
    out = co.terrain_columns(cols(t), ORIGIN.alt, ORIGIN.vy)
    return out.select("vx", "vz", "surface_y", F.round("surface_y_f", 6).alias("surface_y_f"))


PLAIN = "(select vx, vz, cx, cz, terrain_y surface_y, z, 'GRASS' surface, 'DIRT' subsurface, cast(vx % 4 as bigint) soil, case when vz % 7=0 then z+2.5e0 end reservoir_m from {src} c)".replace("{src}", COLS)
RUNS = f"""(select * from (select vx, vz, cx, cz, surface_y-200 y0, surface_y-soil-1 y1, 'STONE' material from {PLAIN} p union all select vx, vz, cx, cz, surface_y-soil, surface_y-1, subsurface from {PLAIN} p
   union all select vx, vz, cx, cz, surface_y, surface_y, case when reservoir_m>z then 'WATER' else surface end from {PLAIN} p
   union all select vx, vz, cx, cz, surface_y+1, surface_y+cast(ceil(reservoir_m-z) as bigint), 'WATER' from {PLAIN} p where reservoir_m>z) q where y1>=y0)"""


def runs(t):
    return co.column_runs(t.sql(f"select * from {PLAIN} p"))


@query("column_runs", f"select vx, vz, y0, y1, material from {RUNS} r")
def column_runs(t):
    return runs(t).select("vx", "vz", "y0", "y1", "material")


@query("column_top", f"select vx, vz, max(y1) top_y, arg_max(material,y1) top_material from {RUNS} r group by vx, vz")
def column_top(t):
    return ag.column_top(runs(t), ["vx", "vz"])


@query("column_ground", f"select vx, vz, max(y1) ground_y, arg_max(material,y1) ground_material from {RUNS} r where material not in ('WATER','LEAVES','WOOD') group by vx, vz")
def column_ground(t):
    return ag.column_ground(runs(t), ["vx", "vz"])


@query("chunk_summary", f"""select cx, cz, cast(sum(n) as bigint) non_air, count(*) filter (water) water_columns, cast(0 as bigint) road_columns, cast(0 as bigint) building_columns, min(g) ground_min, max(g) ground_max from
   (select cx, cz, vx, vz, sum(y1-y0+1) n, bool_or(material='WATER') water, max(case when material<>'WATER' then y1 end) g from {RUNS} r group by cx, cz, vx, vz) q group by cx, cz""")
def chunk_summary(t):
    return ag.chunk_summary(runs(t), ["cx", "cz"])


@query("column_histogram", f"select material, cast(sum(y1-y0+1) as bigint) n from {RUNS} r group by material")
def column_histogram(t):
    return ag.material_histogram(runs(t))


@query("surface_reconstruct", f"""with l as (select cx, cz, vx, vz, cast(floor(surface_y/200e0) as bigint) cy, surface_y, surface_y+case when vx % 3=0 then 0.2e0 when vx % 3=1 then 3e0 end stored from {PLAIN} p)
   select vx, vz, cy, case when stored is null or abs(stored-(surface_y+0.5e0))>1 then surface_y+0.5e0 else stored end surface_y from l
   union all select vx, vz, cast(cy-1 as bigint), case when stored is null then s when abs(stored-s)>1 then s else stored end from (select *, cy*200+2e0 s from l where surface_y-200 < cy*200) z""")
def surface_reconstruct(t):
    c = t.sql(f"select * from {PLAIN} p").drop("reservoir_m")
    k = F.when(F.col("vx") % 3 == 0, 0.2).when(F.col("vx") % 3 == 1, 3.0)
    r = co.by_layer(co.column_runs(c)).join(c.select("vx", "vz", (F.col("surface_y") + k).alias("stored")), ["vx", "vz"])
    return ag.surface_reconstruct(r).select("vx", "vz", "cy", "surface_y")


@query("vegetation")
def vegetation(t):
    flat = cols(t).withColumn("z", F.col("z") / 100.0)
    terrain = co.terrain_columns(flat, ORIGIN.alt, ORIGIN.vy)
    return co.vegetation(terrain).groupBy("cx", "cz", "material").agg(F.sum(F.col("y1") - F.col("y0") + 1).alias("n"))


@query("voxel_edits_apply", f"""with w as (select * from (select op_id*7 % 125 vx, op_id % (select max(r)+1 from dem_cell) vz, cast(op_id*13 % 170 as bigint) vy, material, op_id from op_log) e qualify row_number() over (partition by vx, vz, vy order by op_id desc)=1),
   b as (select vx, vz, material, unnest(range(y0, y1+1)) y from {RUNS} k), c as (select distinct vx, vz from b),
   m as (select coalesce(b.vx,w.vx) vx, coalesce(b.vz,w.vz) vz, case when w.vx is not null then w.material else b.material end material from b full join (select w.* from w join c on c.vx=w.vx and c.vz=w.vz) w on w.vx=b.vx and w.vz=b.vz and w.vy=b.y)
   select vx, vz, material, count(*) n from m where material<>'AIR' group by vx, vz, material""")
def voxel_edits_apply(t):
    win = t.sql("select op_id*7 % 125 vx, op_id % (select max(r)+1 from dem_cell) vz, cast(op_id*13 % 170 as bigint) vy, material, op_id, author, lamport from op_log")
    from ..operators.oplog import lww_register

    win = lww_register(win.withColumn("lamport", F.col("op_id")))
    base = runs(t)
    win = win.join(base.select("vx", "vz").distinct(), ["vx", "vz"], "left_semi")
    out = co.voxel_edits_apply(base, win)
    return out.groupBy("vx", "vz", "material").agg(F.sum(F.col("y1") - F.col("y0") + 1).alias("n"))


# ---------------------------------------------------------------------------------------------------------
# Water
# ---------------------------------------------------------------------------------------------------------
LINE_KIND = "(case line_id % 3 when 0 then 'river' when 1 then 'stream' else 'tidal' end)"


def channel_lines(t):
    elev = t.line_vertex.groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "elev"))), lambda x: x["elev"]).alias("elev"))
    kind = F.when(F.col("line_id") % 3 == 0, "river").when(F.col("line_id") % 3 == 1, "stream").otherwise("tidal")
    return t.lines.withColumn("waterway", kind).join(elev, "line_id")


WATER_KIND = "(case poly_id % 5 when 0 then 'lake' when 1 then 'reservoir' when 2 then 'river' when 3 then 'pond' else 'stream' end)"
BACKBONE = """(select line_id, k, seg, case when k=0 then a_lat else (a_lat+b_lat)*0.5e0 end lat, case when k=0 then a_lon else (a_lon+b_lon)*0.5e0 end lon, line_id*100+seg*10+k pid from
   (select line_id, seq-1 seg, lat a_lat, lon a_lon, lead(lat) over w b_lat, lead(lon) over w b_lon from line_vertex window w as (partition by line_id order by seq) qualify lead(lat) over w is not null) s, (select 0 k union all select 1) k0)"""
BACKED = f"(select distinct h.poly_id, cast(floor(h.pid/100e0) as bigint) line_id from {inside_sql(BACKBONE, 'pid')} h where h.poly_id % 5 in (2,4) and cast(floor(h.pid/100e0) as bigint) % 3 <> 2)"


@query("channel_backing", f"select poly_id, line_id from {BACKED} b")
def channel_backing(t):
    return hy.channel_backing(water_bodies(t), channel_lines(t))


PTS = f"(select *, vx*1000+vz pid from {SMOOTH} c)"


@query("water_polygon_fill", f"""with hit as (select pid, poly_id from {inside_sql(PTS, 'pid')} h), holed as (with m as (select poly_id, avg(lat) my, avg(lon) mx from poly_vertex group by poly_id)
     select v.poly_id, v.seq, m.my+(v.lat-m.my)*0.25e0 lat, m.mx+(v.lon-m.mx)*0.25e0 lon from poly_vertex v join m on v.poly_id=m.poly_id),
   hole as (select pid, poly_id from {inside_sql(PTS, 'pid').replace('poly_vertex', 'holed')} h),
   wet as (select distinct p.cx, p.cz, p.vx, p.vz, p.terrain_y from hit h join {PTS} p on p.pid=h.pid left join hole o on o.pid=h.pid and o.poly_id=h.poly_id where o.pid is null and h.poly_id not in (select poly_id from {BACKED} b)),
   lv as (select cx, cz, greatest(min(terrain_y), max(terrain_y-15)) level_y from wet group by cx, cz)
   select vx, vz, level_y from wet join lv on lv.cx=wet.cx and lv.cz=wet.cz where terrain_y<=level_y+15""")
def water_polygon_fill(t):
    out = hy.water_polygon_fill(cols(t, SMOOTH), water_bodies(t), channel_lines(t))
    return out.select("vx", "vz", "level_y")


# A grid of water surfaces with gaps.
SURF = f"(select cx, cz, vx, vz, vz-cz*30 r, vx-cx*30 c, cast(floor(z) as bigint) z from {COLS} k where (vx*5+vz*3) % 7<>0)"
SURF_NEAR = near_sql(SURF).replace(" on j_", " on j_").replace("select x.r, x.c, x.z z", "select x.cx, x.cz, x.vx, x.vz, x.r, x.c, x.z z")
for _n in NAMES:
    SURF_NEAR = SURF_NEAR.replace(f"on j_{_n}.r=", f"on j_{_n}.cx=x.cx and j_{_n}.cz=x.cz and j_{_n}.r=")
LOW = "least(" + ",".join(NAMES) + ")"
HIGH = "greatest(" + ",".join(NAMES) + ")"
CNT = "+".join(f"(case when {n} is null then 0 else 1 end)" for n in NAMES)


@query("channel_stabilise", f"select vx, vz, case when {CNT}>=2 then least(greatest(z,{LOW}-1),{HIGH}+1) else z end water_y from {SURF_NEAR} q")
def channel_stabilise(t):
    s = t.sql(f"select cx, cz, vx, vz, z water_y from {SURF} s")
    return hy.channel_stabilise(s).select("vx", "vz", "water_y")


CH = """(select o_orderkey id, case when o_custkey % 3=0 then null else cast(o_custkey % 6 as bigint) end wetted, o_orderkey % 2=0 backed, o_orderkey % 3=0 inside, o_orderkey % 5<2 mask, cast(floor(o_totalprice/5000e0) as bigint) terrain_y, cast(o_custkey % 90 as bigint) water_y,
   (o_orderkey % 41)*1e0 dist_m, 1e0+(o_orderkey % 13) half_width_m, 1e0+(o_custkey % 5) center_depth_m from orders)"""


@query("channel_wetting", f"select id, cast(case when inside then case when mask then coalesce(wetted,1) end when backed and not mask then null else wetted end as bigint) wetted from {CH} c")
def channel_wetting(t):
    return t.sql(f"select * from {CH} c").select("id", hy.channel_wetting("wetted", "backed", "inside", "mask").alias("wetted"))


@query("bank_taper", f"""select id, case when terrain_y>water_y and away<zone then least(greatest(water_y+cast(round((terrain_y-water_y)*(s*s*(3-2*s))) as bigint), least(water_y+1,terrain_y)),terrain_y) end bank_y from
   (select *, least(greatest(away/zone,0e0),1e0) s from (select *, greatest(dist_m-half_width_m,0e0) away, least(greatest(greatest(half_width_m*0.75e0,center_depth_m*2),4e0),24e0) zone from {CH} c) q) z""")
def bank_taper(t):
    return t.sql(f"select * from {CH} c").select("id", hy.bank_taper("terrain_y", "water_y", "dist_m", "half_width_m", "center_depth_m").alias("bank_y"))


def rivers(t):
    """Profiles as arrays per line."""
    from ..operators.rivers import river_profile

    kind = F.when(F.col("line_id") % 3 == 0, "river").when(F.col("line_id") % 3 == 1, "stream").otherwise("tidal")
    p = river_profile(t.line_vertex.withColumn("waterway", kind))
    item = F.sort_array(F.collect_list(F.struct("seq", "lat", "lon", "water_m", "half_width_m", "depth_m")))
    g = p.groupBy("line_id").agg(item.alias("_v"))

    def arr(*names):
        return F.transform("_v", lambda v: F.struct(*[v[n].alias(n) for n in names]) if len(names) > 1 else v[names[0]])

    return g.select("line_id", arr("lat", "lon").alias("line"), arr("water_m").alias("water_m"), arr("half_width_m").alias("half_width_m"), arr("depth_m").alias("depth_m"))


def channel_inputs(t):
    columns = cols(t, SMOOTH)
    water, lines = water_bodies(t), channel_lines(t)
    odd = rivers(t).where(F.col("line_id") % 2 == 1)
    return columns, water, lines, hy.channel_profile(columns, odd, lines, water)


@query("channel_profile")
def channel_profile(t):
    p = channel_inputs(t)[3]
    return p.select("vx", "vz", "line_id", F.round("dist_m", 4).alias("dist_m"), F.round("carve_m", 4).alias("carve_m"), "polygon_backed", "inside_polygon", "wetted")


def _gap_grid(t):
    """Every column with terrain 3 above a wavy water surface; wet where a pattern says so."""
    s = t.sql(f"select cx, cz, vx, vz, vx-cx*30 x, vz-cz*30 z from {COLS} c")
    wet = (F.col("x") * 3 + F.col("z") * 5 + F.col("cx")) % 7 < 2
    w = F.when(wet, big(F.lit(50) + F.floor(F.col("x") / 8)))
    return s.select("cx", "cz", "vx", "vz", w.alias("water_y"), big(F.lit(53) + F.floor(F.col("x") / 8)).alias("terrain_y"), F.when(wet, (F.col("x") % 3 + 1).cast("bigint")).alias("wetted"),
                    F.when(wet, F.lit(3.0)).alias("half_width_m"), F.when(wet, F.lit(2.0)).alias("center_depth_m"), F.when(wet, F.lit(1.0)).alias("dist_m"), F.when(wet, F.lit(False)).alias("polygon_backed"), F.when(wet, F.lit(False)).alias("inside_polygon"), F.lit(False).alias("mask"))


@query("channel_bridge")
def channel_bridge(t):
    out = hy.channel_bridge(_gap_grid(t))
    return out.where("bridged").select("vx", "vz", "water_y", "wetted")


@query("hydro_runs")
def hydro_runs(t):
    columns, water, lines, profile = channel_inputs(t)
    done = hy.channel_pass(columns, profile, ORIGIN.alt, ORIGIN.vy)
    return hy.hydro_runs(done).groupBy("cx", "cz", "material").agg(F.sum(F.col("y1") - F.col("y0") + 1).alias("n"))


# ---------------------------------------------------------------------------------------------------------
# Roads
# ---------------------------------------------------------------------------------------------------------
# Columns one metre apart along the first segments of the site lines.
ROAD_COLS = """(select site_id cx, cast(0 as bigint) cz, cast(k as bigint) vx, site_id vz, v.lat+(k-12)*0.000009e0*((site_id % 3)-1) lat, v.lon+(k-12)*0.000010e0 lon, 40+k % 5 terrain_y from site s join line_vertex v on v.line_id=s.site_id and v.seq=2, range(25) r(k))"""
ROAD_CLS = "(case line_id % 5 when 0 then 'Motorway' when 1 then 'Primary' when 2 then 'Residential' when 3 then 'Path' else 'Service' end)"


def roads(t):
    k = F.col("line_id") % 5
    cls = F.element_at(F.array(*[F.lit(x) for x in ("Motorway", "Primary", "Residential", "Path", "Service")]), (k + 1).cast("int"))
    return t.lines.select(F.col("line_id").alias("road_id"), cls.alias("cls"), "line", (F.col("line_id") % 7 == 0).alias("is_bridge"), (F.col("line_id") % 7 == 1).alias("is_tunnel"), (F.col("line_id") % 3).alias("layer"))


def road_cols(t):
    v = t.line_vertex.where("seq = 2").select(F.col("line_id").alias("site_id"), "lat", "lon")
    c = t.site.select("site_id").join(v, "site_id").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))))
    return c.select(F.col("site_id").alias("cx"), F.lit(0).cast("bigint").alias("cz"), F.col("k").alias("vx"), F.col("site_id").alias("vz"),
                    (F.col("lat") + (F.col("k") - 12) * 0.000009 * ((F.col("site_id") % 3) - 1)).alias("lat"), (F.col("lon") + (F.col("k") - 12) * 0.00001).alias("lon"), (F.col("k") % 5 + 40).alias("terrain_y"))


ROAD_HIT = f"""(select c.vx, c.vz, s.line_id, s.seg, d.dist_m, {case_sql(ROAD_CLS.replace('line_id', 's.line_id'), rules.ROAD_ATTRS, pick=lambda v: v[0])}/2e0 half, {case_sql(ROAD_CLS.replace('line_id', 's.line_id'), rules.ROAD_ATTRS, pick=lambda v: v[2])} foot,
   {case_sql(ROAD_CLS.replace('line_id', 's.line_id'), rules.ROAD_ATTRS, pick=lambda v: v[3])} material from {ROAD_COLS} c join (select line_id, seq-1 seg, lat a_lat, lon a_lon, lead(lat) over w b_lat, lead(lon) over w b_lon from line_vertex window w as (partition by line_id order by seq) qualify lead(lat) over w is not null) s on true,
   lateral (select {dist_t_sql('c.lat', 'c.lon').replace('a_l', 's.a_l').replace('b_l', 's.b_l')}) d)"""


@query("road_columns", f"""select vx, vz, line_id road_id, round(dist_m,4) dist_m, case when dist_m<=half then 'carriageway' else 'footpath' end zone, case when dist_m<=half then material else 'CONCRETE' end material from
   (select * from {ROAD_HIT} h where dist_m<=half+foot+2 qualify row_number() over (partition by vx, vz order by round(dist_m,7), line_id, seg)=1) q where dist_m<=half or (foot>0 and dist_m<=half+foot)""")
def road_columns(t):
    out = rd.road_columns(road_cols(t), roads(t))
    return out.select("vx", "vz", "road_id", F.round("dist_m", 4).alias("dist_m"), "zone", "material")


def flat_sample(points, ids):
    """Heights from a plane, standing in for an elevation source."""
    return points.select(*ids, ((F.col("lat") + 27.6) * 300.0 + (F.col("lon") - 153.0) * 200.0).alias("z"))


def graded(t):
    return rd.road_grade(rd.road_columns(road_cols(t), roads(t)), flat_sample, ORIGIN.alt, ORIGIN.vy)


@query("road_grade")
def road_grade(t):
    return graded(t).select("vx", "vz", "road_id", "road_y")


@query("road_crossing_mode")
def road_crossing_mode(t):
    hits, columns, wet = crossing_inputs(t)
    return rd.road_crossing_mode(hits, wet, columns, wet.select("vx", "vz")).select("vx", "vz", "mode", "bridge_y", "culvert_floor", "culvert_top")


def crossing_inputs(t):
    """Roads over voxel columns with ponds; positions come from the columns' own place on the ellipsoid."""
    chunks = t.supplier.select((F.lit(44600) + F.col("s_suppkey") % 5).alias("cx"), (F.lit(113400) + F.floor(F.col("s_suppkey") / 5) % 5).alias("cz")).distinct()
    columns = co.chunk_columns(chunks, F.lit(ORIGIN.ecef_y))
    ends = columns.where((F.col("vx") % 30 == 4) & (F.col("vz") % 30 == 3) | (F.col("vx") % 30 == 25) & (F.col("vz") % 30 == 26))
    line = F.transform(F.sort_array(F.collect_list(F.struct("vx", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    roads_ = ends.groupBy("cx", "cz").agg(line.alias("line")).select((F.col("cx") * 1000000 + F.col("cz")).alias("road_id"), F.lit("Primary").alias("cls"), "line", F.lit(False).alias("is_bridge"), F.lit(False).alias("is_tunnel"), F.lit(0).alias("layer"))
    hits = rd.road_columns(columns, roads_).withColumn("road_y", F.lit(60).cast("bigint"))
    wet = columns.where((F.col("vx") % 30 < 12) & (F.col("cx") % 2 == 0)).select("cx", "cz", "vx", "vz", F.lit(50).cast("bigint").alias("floor_y"), F.lit(54).cast("bigint").alias("top_y"))
    return hits, columns, wet


@query("road_runs")
def road_runs(t):
    hits = graded(t).join(road_cols(t).select("cx", "cz", "vx", "vz", "terrain_y"), co.COLUMN)
    full = hits.withColumn("terrain_material", F.when(F.col("vx") % 6 == 0, "WATER").otherwise("GRASS")).withColumn("bridge_y", F.lit(None).cast("bigint"))
    full = full.withColumn("culvert_floor", F.lit(None).cast("bigint")).withColumn("culvert_top", F.lit(None).cast("bigint")).withColumn("water_floor", F.when(F.col("vx") % 6 == 0, F.col("terrain_y") - 2))
    return rd.road_runs(full).select("vx", "vz", "y0", "y1", "material")


@query("anchor_nearest", f"""select p.site_id target, arg_min(c.vx, struct_pack(d := round(d,6), w := -c.vx, z := c.vz)) x from (select * from site where site_id>=0) p, {SMOOTH} c, lateral (select sqrt(power((c.lat-p.lat)*111320e0,2e0)+power((c.lon-p.lon)*111320e0*cos(radians(p.lat)),2e0)) d) k
   where d<=120 group by p.site_id""".replace("w := -c.vx", "w := c.vx"))
def anchor_nearest(t):
    from ..operators.report import anchor_nearest

    targets = t.site.select(F.col("site_id").alias("target"), "lat", "lon")
    out = anchor_nearest(targets, cols(t, SMOOTH).withColumn("y", F.col("terrain_y")), 120.0)
    return out.select("target", F.col("vx").alias("x"))


# Columns a quarter of a cell off the height cells, so that each height lies between four.
BAKED = """(select cast(floor(c/30e0) as bigint) cx, cast(floor(r/30e0) as bigint) cz, c vx, r vz, -27.56e0+(r+0.25e0)*0.0008e0 lat, 153.02e0+(c+0.25e0)*0.0008e0 lon from dem_cell)"""


def bake_grid(t):
    return Grid(-27.56, 153.02, 0.0008, (t.dem_cell.agg(F.max("r")).first()[0] or 0) + 1, 125)


def bake_sources(t, **more):
    grid = bake_grid(t)
    heights = t.dem_cell.withColumn("z", F.col("z") / 30.0)

    def sample(points, ids):
        return el.dem_bilinear(points, heights, grid, ids)

    def place(lat, lon):
        return big(F.floor((lon - 153.02) / 0.0008)), big(F.floor((lat + 27.56) / 0.0008))

    return rb.Sources(sample, t.sql(f"select * from {BAKED} c"), place, **more), grid


def full_sources(t):
    """All inputs of a bake: land areas, shores, water, roads, edits from the log and objects of the map."""
    from ..operators.oplog import lww_register
    from .features import map_objects
    from .rasters import areas

    size = t.dem_cell.agg(F.max("r").alias("r")).first()["r"] or 0
    edits = lww_register(t.sql("select op_id*7 % 125 vx, op_id*11 vz, cast(90+op_id*13 % 30 as bigint) vy, material, op_id, author, op_id lamport from op_log").withColumn("vz", F.col("vz") % (size + 1)))
    return bake_sources(t, areas=areas(t), coast=t.lines.where("line_id % 4 = 0"), water=water_bodies(t), rivers=rivers(t), lines=channel_lines(t), roads=roads(t), edits=edits, objects=map_objects(t))


@query("region_bake")
def region_bake(t):
    """The whole bake over the columns at the height cells; the manifest of the last pass that writes columns."""
    path = sinks.new_folder(shared_dir(t.spark), "bake")
    sources, grid = full_sources(t)
    return rb.manifest(rb.region_bake(path, sources, grid, ORIGIN), path, grid.region).select("chunk", "region", "size")


@query("baked_objects")
def baked_objects(t):
    """Objects of the map on the ground of a bake of terrain alone."""
    from .features import map_objects

    sources, grid = bake_sources(t, objects=map_objects(t))
    store = rb.region_bake(sinks.new_folder(shared_dir(t.spark), "bake"), sources, grid, ORIGIN)
    return store.read("objects").select("cx", "cz", "object_id", "kind", "y")


@query("bake_terrain", f"""with d as (select r, c, z/30e0 z, row_number() over (order by z) rn, count(*) over () n from dem_cell),
   m as (select case when z > -8 and z < 12 then -z else 0e0 end off from d where rn = cast(floor(least(greatest(floor(n/50e0),1),30)/2e0) as bigint)+1),
   e as (select r, c, z+off z from d, m), k as (select c.cx, c.cz, c.vx, c.vz, c.lat, c.lon, sum(e.z*(case when e.r=c.vz then 0.75e0 else 0e0 end + case when e.r=least(c.vz+1,(select max(r) from e)) then 0.25e0 else 0e0 end)
     *(case when e.c=c.vx then 0.75e0 else 0e0 end + case when e.c=least(c.vx+1,124) then 0.25e0 else 0e0 end)) z from {BAKED} c join e on e.r between c.vz and c.vz+1 and e.c between c.vx and c.vx+1 group by all),
   s as (select cx, cz, cast(trunc(z+{GEOID_SQL}-20e0) as bigint)+100 y from (select *, lon l from k) q)
   select cx, cz, count(*) n, cast(sum(201) as bigint) non_air, min(y) ground_min, max(y) ground_max from s group by cx, cz""")
def bake_terrain(t):
    """Terrain of the bake, from heights and datum offset to the stored chunks, summed by chunk."""
    sources, grid = bake_sources(t)
    store = rb.region_bake(sinks.new_folder(shared_dir(t.spark), "bake"), sources, grid, ORIGIN, trees=False, upto="terrain")
    runs = store.read("terrain")
    size = runs.groupBy("cx", "cz").agg(F.count_distinct("vx", "vz").alias("n"))
    return ag.chunk_summary(runs, ["cx", "cz"]).join(size, ["cx", "cz"]).select("cx", "cz", "n", "non_air", "ground_min", "ground_max")
