"""Queries for grids: focal metrics, flow, distances and rasterised features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import big
from ..operators import raster, spatial_join as sj
from ..operators.spatial_join import Grid
from .catalog import query
from .scalars import CLIMATE_SQL, EDGE_SQL, SEG_SQL, area_type, AREA_TYPE_SQL, case_sql, crossing_sql, dist_t_sql

STEP = 0.0003
CELL_M = 111320.0 * STEP
# A 200 x 160 window over the sites, used by the rasterising queries.
GRID = Grid(-27.6, 153.0, 0.0015, 180, 140)
GRID_CTE = "(select r.range r, c.range c from range(180) r, range(140) c)"


def near_sql(src: str = "dem_cell", value: str = "z") -> str:
    """Cells with their eight neighbours, by left joins on the shifted index."""
    cols, joins = [], []
    for (dr, dc), name in zip(raster.D8, raster.D8_NAMES):
        cols.append(f"j_{name}.{value} {name}")
        joins.append(f"left join {src} j_{name} on j_{name}.r=x.r+({dr}) and j_{name}.c=x.c+({dc})")
    return f"(select x.r, x.c, x.{value} z, {', '.join(cols)} from {src} x {' '.join(joins)})"


HORN = f"""(select *, ((se2+2e0*e2+ne2)-(sw2+2e0*w2+nw2))/(8e0*{CELL_M!r}) dx, ((nw2+2e0*n2+ne2)-(sw2+2e0*s2+se2))/(8e0*{CELL_M!r}) dy from
   (select *, coalesce(n,z) n2, coalesce(s,z) s2, coalesce(e,z) e2, coalesce(w,z) w2, coalesce(ne,n,e,z) ne2, coalesce(nw,n,w,z) nw2,
    coalesce(se,s,e,z) se2, coalesce(sw,s,w,z) sw2 from {near_sql()} k) k2)"""
SLOPE_SQL = f"(select r, c, z, degrees(atan(sqrt(dx*dx+dy*dy))) slope_deg, fmod(degrees(atan2(dx,dy))+360e0,360e0) gradient_azimuth from {HORN} h)"
NAMES = raster.D8_NAMES
ABS_SUM = "+".join(f"coalesce(abs(z-{n}),0e0)" for n in NAMES)
COUNT = "+".join(f"(case when {n} is null then 0 else 1 end)" for n in NAMES)
TRI_SQL = f"(select r, c, z, ({ABS_SUM})/({COUNT}) tri from {near_sql()} k)"
DROP = {n: f"coalesce((z-{n})/({CELL_M * (math.sqrt(2.0) if len(n) == 2 else 1.0)!r}),-1e0)" for n in NAMES}
BEST = "greatest(" + ",".join(DROP.values()) + ")"
DIR_CASE = "case when " + BEST + "<=0 then 8 " + " ".join(f"when {DROP[n]}={BEST} then {i}" for i, n in enumerate(NAMES)) + " end"
DIR_SQL = f"(select r, c, z, cast({DIR_CASE} as bigint) dir from {near_sql()} k)"


@query("slope_aspect", f"select r, c, round(slope_deg,7) slope_deg, round(gradient_azimuth,6) gradient_azimuth from {SLOPE_SQL} s")
def slope_aspect(t):
    near = raster.neighbours(t.dem_cell)
    out = raster.with_slope_aspect(near, STEP)
    return out.select("r", "c", F.round("slope_deg", 7).alias("slope_deg"), F.round("gradient_azimuth", 6).alias("gradient_azimuth"))


@query("tri", f"select r, c, round(tri,9) tri from {TRI_SQL} s")
def tri(t):
    return raster.neighbours(t.dem_cell).select("r", "c", F.round(raster.tri(), 9).alias("tri"))


@query("tri_ragged", f"select r, c, round(({ABS_SUM})/nullif({COUNT},0),9) tri from {near_sql('(select * from dem_cell where (r*7+c*3) % 11 <> 0)')} k")
def tri_ragged(t):
    """Ruggedness on a grid with holes, where diagonal neighbours of a hole still count."""
    near = raster.neighbours(holed(t))
    return near.select("r", "c", F.round(raster.tri(), 9).alias("tri"))


HOLED = "(select * from dem_cell where (r*7+c*3) % 11 <> 0)"


def holed(t):
    return t.dem_cell.where((F.col("r") * 7 + F.col("c") * 3) % 11 != 0)


@query("slope_aspect_ragged", "select r, c, round(slope_deg,7) slope_deg, round(gradient_azimuth,6) gradient_azimuth from " + SLOPE_SQL.replace(near_sql(), near_sql(HOLED)) + " s")
def slope_aspect_ragged(t):
    out = raster.with_slope_aspect(raster.neighbours(holed(t)), STEP)
    return out.select("r", "c", F.round("slope_deg", 7).alias("slope_deg"), F.round("gradient_azimuth", 6).alias("gradient_azimuth"))


@query("d8_direction_ragged", "select r, c, dir from " + DIR_SQL.replace(near_sql(), near_sql(HOLED)) + " s")
def d8_direction_ragged(t):
    return raster.neighbours(holed(t)).select("r", "c", raster.d8_direction(STEP).alias("dir"))


@query("d8_direction", f"select r, c, dir from {DIR_SQL} s")
def d8_direction(t):
    return raster.neighbours(t.dem_cell).select("r", "c", raster.d8_direction(STEP).alias("dir"))


DR = "(case dir when 0 then 1 when 1 then 1 when 7 then 1 when 3 then -1 when 4 then -1 when 5 then -1 else 0 end)"
DC = "(case dir when 1 then 1 when 2 then 1 when 3 then 1 when 5 then -1 when 6 then -1 when 7 then -1 else 0 end)"
FLOW_CTE = f"""with recursive d as materialized (select r, c, dir, r+{DR} nr, c+{DC} nc from {DIR_SQL} s),
   walk as (select r sr, c sc, r, c from d union all select w.sr, w.sc, d.nr, d.nc from walk w join d on d.r=w.r and d.c=w.c where d.dir<8)"""
ACC_SQL = "(select r, c, count(*) acc from walk group by r, c)"


def _accumulated(t, block=64):
    terrain = raster.terrain(t.dem_cell, STEP)
    acc = raster.flow_accumulation(terrain.select("region", "r", "c", "dir"), block=block)
    return terrain, acc


@query("flow_accumulation", f"{FLOW_CTE} select r, c, acc from {ACC_SQL} a")
def flow_accumulation(t):
    return _accumulated(t)[1].select("r", "c", "acc")


@query("twi", f"{FLOW_CTE} select a.r, a.c, round(ln(greatest(acc,1)/tan(greatest(radians(slope_deg),0.001e0))),6) twi from {ACC_SQL} a join {SLOPE_SQL} s on a.r=s.r and a.c=s.c")
def twi(t):
    terrain, acc = _accumulated(t)
    both = terrain.join(acc, ["region", "r", "c"])
    return both.select("r", "c", F.round(raster.twi("acc", "slope_deg"), 6).alias("twi"))


@query("terrain_classes", f"""select case when tri>120 then 'rugged' when tri>60 then 'broken' else 'smooth' end cls, count(*) n, round(avg(slope_deg),5) slope_deg, round(max(tri),5) tri
    from {TRI_SQL} a join {SLOPE_SQL} s on a.r=s.r and a.c=s.c group by 1""")
def terrain_classes(t):
    """Flagship: focal metrics of every cell in one shuffle, summed by ruggedness class."""
    out = raster.terrain(t.dem_cell, STEP)
    cls = F.when(F.col("tri") > 120, "rugged").when(F.col("tri") > 60, "broken").otherwise("smooth")
    return out.groupBy(cls.alias("cls")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("slope_deg"), 5).alias("slope_deg"), F.round(F.max("tri"), 5).alias("tri")
    )


COAST_STEP = 0.02
COAST_M = 111320.0 * COAST_STEP


@query("coast_distance", f"""select x.r, x.c, round(case when (min(k)-1)*{COAST_M!r}<50000e0 then min(k)*{COAST_M!r} else 50000e0 end,3) coast_m from dem_cell x
    join (select *, null k from dem_cell where z>470) s on true, lateral (select abs(x.r-s.r)+abs(x.c-s.c) k) d group by x.r, x.c""".replace(", null k", ""))
def coast_distance(t):
    cells = t.dem_cell.withColumn("coast", F.col("z") > 470)
    out = raster.coast_distance(cells, COAST_STEP)
    return out.select("r", "c", F.round("coast_m", 3).alias("coast_m"))


@query("dilate_mask", "select x.r, x.c, exists(select 1 from dem_cell y where y.z>480 and abs(y.r-x.r)<=2 and abs(y.c-x.c)<=2) dilated from dem_cell x")
def dilate_mask(t):
    cells = t.dem_cell.withColumn("mark", F.col("z") > 480)
    return raster.dilate_mask(cells, "mark", 2).select("r", "c", "dilated")


@query("halo_rings", """select x.r, x.c, min(greatest(abs(x.r-y.r),abs(x.c-y.c))) ring from dem_cell x join (select r, c from dem_cell where z>480) y
    on abs(x.r-y.r)<=2 and abs(x.c-y.c)<=2 group by x.r, x.c having min(greatest(abs(x.r-y.r),abs(x.c-y.c)))>0""")
def halo_rings(t):
    inside = t.dem_cell.where(F.col("z") > 480).select("region", "r", "c")
    rings = raster.halo_rings(inside, ["region"])
    return rings.join(t.dem_cell.select("region", "r", "c"), ["region", "r", "c"], "left_semi").select("r", "c", "ring")


@query("local_relief", f"""select r, c, round(greatest(z,{','.join(f'coalesce({n},z)' for n in NAMES)})-least(z,{','.join(f'coalesce({n},z)' for n in NAMES)}),6) relief,
    round(greatest(abs(coalesce(e,z)-coalesce(w,z)),abs(coalesce(n,z)-coalesce(s,z)))/2e0,6) local_slope from {near_sql()} k""")
def local_relief(t):
    out = raster.local_relief(t.dem_cell)
    return out.select("r", "c", F.round("relief", 6).alias("relief"), F.round("local_slope", 6).alias("local_slope"))


# Integer surface columns in chunks of 30 x 30: one column per cell.
COLUMNS = """(select cast(floor(r/30e0) as bigint) cx, cast(floor(c/30e0) as bigint) cz, r vx, c vz, cast(floor(z) as bigint) surface_y from dem_cell)"""


@query("column_slope", f"""select vx, vz, round(degrees(atan(sqrt(gx*gx+gz*gz))),6) slope_deg from (select x.vx, x.vz,
    (coalesce(e.surface_y,x.surface_y)-coalesce(w.surface_y,x.surface_y))/greatest(coalesce(e.vx,x.vx)-coalesce(w.vx,x.vx),1) gx,
    (coalesce(n.surface_y,x.surface_y)-coalesce(s.surface_y,x.surface_y))/greatest(coalesce(n.vz,x.vz)-coalesce(s.vz,x.vz),1) gz from {COLUMNS} x
    left join {COLUMNS} e on e.cx=x.cx and e.cz=x.cz and e.vx=x.vx+1 and e.vz=x.vz left join {COLUMNS} w on w.cx=x.cx and w.cz=x.cz and w.vx=x.vx-1 and w.vz=x.vz
    left join {COLUMNS} n on n.cx=x.cx and n.cz=x.cz and n.vz=x.vz+1 and n.vx=x.vx left join {COLUMNS} s on s.cx=x.cx and s.cz=x.cz and s.vz=x.vz-1 and s.vx=x.vx) q""")
def column_slope(t):
    cols = t.sql(f"select * from {COLUMNS} k")
    return raster.column_slope(cols, ["cx", "cz"]).select("vx", "vz", F.round("slope_deg", 6).alias("slope_deg"))


# ---------------------------------------------------------------------------------------------------------
# Rasterised features
# ---------------------------------------------------------------------------------------------------------
CELLS = f"(select r, c, -27.6e0+r*0.0015e0 y0, least(-27.6e0+r*0.0015e0+0.0015e0,{GRID.lat_max!r}) y1, 153e0+c*0.0015e0 x0, least(153e0+c*0.0015e0+0.0015e0,{GRID.lon_max!r}) x1 from {GRID_CTE} g)"
BOXES = "(select poly_id, min(lat) lat0, max(lat) lat1, min(lon) lon0, max(lon) lon1 from poly_vertex group by poly_id)"
CANDIDATES = f"""(select b.poly_id, k.* from {BOXES} b join {CELLS} k on k.r between greatest(floor((b.lat0+27.6e0)/0.0015e0),0) and least(ceil((b.lat1+27.6e0)/0.0015e0),179)
   and k.c between greatest(floor((b.lon0-153e0)/0.0015e0),0) and least(ceil((b.lon1-153e0)/0.0015e0),139))"""


def _odd(y, x):
    return (f"(sum(case when (e.lo > {x}) <> (e.lob > {x}) and {y} < (e.lb-e.la)*({x}-e.lo)/(e.lob-e.lo)+e.la then 1 else 0 end) % 2 = 1)")


def _side(c, d):
    return crossing_sql("a", "b", c, d)


CORNER = {"p": ("y0", "x0"), "q": ("y0", "x1"), "u": ("y1", "x1"), "v": ("y1", "x0")}
TOUCH = f"""(select poly_id, r, c from (select k.poly_id, k.r, k.c, {_odd('(k.y0+k.y1)*0.5e0', '(k.x0+k.x1)*0.5e0')} or {_odd('k.y0', 'k.x0')} or {_odd('k.y0', 'k.x1')} or {_odd('k.y1', 'k.x1')}
    or {_odd('k.y1', 'k.x0')} or bool_or(e.la between k.y0 and k.y1 and e.lo between k.x0 and k.x1) or bool_or(hit) touch
    from (select k.*, e.la, e.lo, e.lb, e.lob, e.seq, {' or '.join(_side(a, b) for a, b in (('p', 'q'), ('q', 'u'), ('u', 'v'), ('v', 'p')))} hit from
      (select *, y0 p_lat, x0 p_lon, y0 q_lat, x1 q_lon, y1 u_lat, x1 u_lon, y1 v_lat, x0 v_lon from {CANDIDATES} k0) k join
      (select *, la a_lat, lo a_lon, lb b_lat, lob b_lon from {EDGE_SQL} e0) e on e.poly_id=k.poly_id) k, lateral (select k.la, k.lo, k.lb, k.lob) e group by k.poly_id, k.r, k.c) z where touch)"""
CENTRE = f"""(select k.poly_id, k.r, k.c from (select *, -27.6e0+(r+0.5e0)*0.0015e0 y, 153e0+(c+0.5e0)*0.0015e0 x from {CANDIDATES} k0) k join {EDGE_SQL} e on e.poly_id=k.poly_id
    group by k.poly_id, k.r, k.c having {_odd('any_value(k.y)', 'any_value(k.x)').replace('any_value(k.y)', 'k.y').replace('any_value(k.x)', 'k.x')})"""


@query("rasterize_polygons", f"select poly_id, r, c from {TOUCH} t")
def rasterize_polygons(t):
    return sj.rasterize_polygons(t.polygons, GRID).select("poly_id", "r", "c")


@query("polygon_hits_cell", f"select poly_id, count(*) n from {TOUCH} t group by poly_id")
def polygon_hits_cell(t):
    """The single-cell predicate on the cells the rasteriser found."""
    from ..functions.geometry import polygon_hits_cell as hits

    cells = sj.rasterize_polygons(t.polygons, GRID, carry=["polygon"])
    met = cells.where(hits("polygon", GRID.cell_box(F.col("r"), F.col("c"))))
    return met.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"))


@query("rasterize_centres", f"select poly_id, r, c from {CENTRE} t")
def rasterize_centres(t):
    return sj.rasterize_polygons(t.polygons, GRID, "centre").select("poly_id", "r", "c")


@query("ocean_mask", f"select r, c from {GRID_CTE} g where not exists (select 1 from {CENTRE} k where k.r=g.r and k.c=g.c)")
def ocean_mask(t):
    """Cells with their centre in no land polygon; the grid is generated from its extent on the executors."""
    land = sj.rasterize_polygons(t.polygons, GRID, "centre").select("r", "c")
    from ..operators.elevation import grid_cells

    return grid_cells(t.spark, GRID).join(land, ["r", "c"], "left_anti").select("r", "c")


AREAS = f"(select poly_id, poly_id seq, {AREA_TYPE_SQL.format(k='poly_id')} area_type from (select distinct poly_id from poly_vertex))"


def areas(t):
    return t.polygons.withColumn("area_type", area_type(F.col("poly_id"))).withColumn("seq", F.col("poly_id"))


@query("landuse_raster", f"""select r, c, arg_max(cls, struct_pack(p := p, seq := seq)) landuse from (select t.r, t.c, a.seq, {case_sql('area_type', rules.LANDUSE_CLASS)} cls,
    {case_sql(case_sql('area_type', rules.LANDUSE_CLASS), rules.LANDUSE_PRIORITY)} p from {TOUCH} t join {AREAS} a on a.poly_id=t.poly_id) q where cls is not null group by r, c""")
def landuse_raster(t):
    from ..operators.ground import landuse_raster

    return landuse_raster(areas(t), GRID).select("r", "c", "landuse")


@query("rasterize_line_buffer", f"""select line_id, r, c from (select b.line_id, k.r, k.c, min(d.dist_m) d, any_value(b.reach) reach from
    (select line_id, lat0-hw/111320e0 y0, lat1+hw/111320e0 y1, lon0-hw/(111320e0*greatest(abs(cos(radians((lat0+lat1)*0.5e0))),0.1e0)) x0, lon1+hw/(111320e0*greatest(abs(cos(radians((lat0+lat1)*0.5e0))),0.1e0)) x1,
      hw+0.5e0*sqrt(power(111320e0*0.0015e0,2e0)+power(111320e0*0.0015e0*greatest(abs(cos(radians((lat0-hw/111320e0+lat1+hw/111320e0)*0.5e0))),0.1e0),2e0)) reach
      from (select line_id, min(lat) lat0, max(lat) lat1, min(lon) lon0, max(lon) lon1, 35e0 hw from line_vertex group by line_id)) b
    join {CELLS} k on k.r between greatest(floor((b.y0+27.6e0)/0.0015e0),0) and least(ceil((b.y1+27.6e0)/0.0015e0),179) and k.c between greatest(floor((b.x0-153e0)/0.0015e0),0) and least(ceil((b.x1-153e0)/0.0015e0),139)
    join {SEG_SQL} s on s.line_id=b.line_id, lateral (select {dist_t_sql('(-27.6e0+(k.r+0.5e0)*0.0015e0)', '(153e0+(k.c+0.5e0)*0.0015e0)', True).replace('a_', 's.a_').replace('b_', 's.b_')}) d group by b.line_id, k.r, k.c) q where d <= reach""")
def rasterize_line_buffer(t):
    return sj.rasterize_line_buffer(t.lines, GRID, F.lit(35.0)).select("line_id", "r", "c")


# The digital line in SQL: the loop over the error term, one row per step.
LINE_CELLS = f"""with recursive ends as (select line_id, seg, cast(round((a_lat+27.6e0)/0.0015e0) as bigint) r0, cast(round((a_lon-153e0)/0.0015e0) as bigint) c0,
    cast(round((b_lat+27.6e0)/0.0015e0) as bigint) r1, cast(round((b_lon-153e0)/0.0015e0) as bigint) c1 from {SEG_SQL} s),
  walk as (select line_id, seg, r0 r, c0 c, r1, c1, abs(c1-c0) dc, abs(r1-r0) dr, abs(c1-c0)-abs(r1-r0) err from ends
    union all select line_id, seg, case when 2*err < dc then r+cast(sign(r1-r) as bigint) else r end, case when 2*err > -dr then c+cast(sign(c1-c) as bigint) else c end, r1, c1, dc, dr,
      err - case when 2*err > -dr then dr else 0 end + case when 2*err < dc then dc else 0 end from walk where r<>r1 or c<>c1)"""


@query("rasterize_lines", f"{LINE_CELLS} select line_id, seg, r, c from walk where r between 0 and 179 and c between 0 and 139")
def rasterize_lines(t):
    return sj.rasterize_lines(sj.explode_segments(t.lines), GRID).select("line_id", "seg", "r", "c")


@query("coast_cells", f"{LINE_CELLS} select distinct r, c from walk where r between 0 and 179 and c between 0 and 139")
def coast_cells(t):
    return sj.rasterize_lines(sj.explode_segments(t.lines), GRID).select("r", "c").distinct()


@query("coast_distance_far", f"""select x.r, x.c, round(least(min(d.dist_m),50000e0),4) coast_m from (select r, c, -27.6e0+r*0.0015e0 lat, 153e0+c*0.0015e0 lon from dem_cell) x
    join (select a_lat-0.1e0 a_lat, a_lon-0.2e0 a_lon, b_lat-0.1e0 b_lat, b_lon-0.2e0 b_lon from {SEG_SQL} k where line_id % 8 = 0) s on true, lateral (select {dist_t_sql('x.lat', 'x.lon', True).replace('a_l', 's.a_l').replace('b_l', 's.b_l')}) d group by x.r, x.c""")
def coast_distance_far(t):
    """A grid that no shore crosses: distances to shore segments outside it."""
    cells = t.dem_cell.select("region", "r", "c", (F.col("r") * 0.0015 - 27.6).alias("lat"), (F.col("c") * 0.0015 + 153.0).alias("lon"), F.lit(False).alias("coast"))
    away = F.transform("line", lambda p: F.struct((p["lat"] - 0.1).alias("lat"), (p["lon"] - 0.2).alias("lon")))
    shores = sj.explode_segments(t.lines.where("line_id % 8 = 0").withColumn("line", away))
    out = raster.coast_distance(cells, 0.0015, segments=shores)
    return out.select("r", "c", F.round("coast_m", 4).alias("coast_m"))


# ---------------------------------------------------------------------------------------------------------
# Reservoirs, ground and components
# ---------------------------------------------------------------------------------------------------------
WATER_KIND = "(case poly_id % 5 when 0 then 'lake' when 1 then 'reservoir' when 2 then 'river' when 3 then 'pond' else 'stream' end)"
HEIGHTS = "(select r, c, z/10e0 z from dem_cell)"
WET = f"""(select k.poly_id, k.r, k.c, h.z, {WATER_KIND.replace('poly_id', 'k.poly_id')} kind, (b.lat1-b.lat0)*(b.lon1-b.lon0)*111320e0*111320e0/1e6 km2, row_number() over (partition by k.poly_id order by h.z) rn,
   count(*) over (partition by k.poly_id) n, avg(h.z) over (partition by k.poly_id) zm from {CENTRE} k join {HEIGHTS} h on h.r=k.r and h.c=k.c join {BOXES} b on b.poly_id=k.poly_id)"""
LEVELS = f"""(select poly_id, greatest(z,0.1e0) level_m from {WET} w where n>=5 and rn=cast(floor(n*0.4e0) as bigint)+1 and kind not in ('river','stream')
   and (kind in ('reservoir','pond') or (zm>=5 and km2>=0.05e0)))"""


def heights(t):
    return t.dem_cell.select("r", "c", (F.col("z") / 10.0).alias("z"))


@query("reservoir_surface", f"select k.r, k.c, round(max(l.level_m),6) level_m from {CENTRE} k join {HEIGHTS} h on h.r=k.r and h.c=k.c join {LEVELS} l on l.poly_id=k.poly_id where h.z <= l.level_m+2 group by k.r, k.c")
def reservoir_surface(t):
    from ..operators.ground import reservoir_surface
    from .scalars import water_bodies

    out = reservoir_surface(water_bodies(t), heights(t), GRID)
    return out.select("r", "c", F.round("level_m", 6).alias("level_m"))


@query("bench_target", f"""select poly_id, round(z,6) target_m from (select k.poly_id, h.z, row_number() over (partition by k.poly_id order by h.z) rn, count(*) over (partition by k.poly_id) n
    from {TOUCH} k join {HEIGHTS} h on h.r=k.r and h.c=k.c) q where rn=greatest((n+1)//2,1)//2+1""")
def bench_target(t):
    from ..operators.ground import bench_target

    cells = sj.rasterize_polygons(t.polygons, GRID).select("poly_id", "r", "c").join(heights(t), ["r", "c"])
    return bench_target(cells, ["poly_id"]).select("poly_id", F.round("target_m", 6).alias("target_m"))


SELF_EDGES = f"(select *, la a_lat, lo a_lon, lb b_lat, lob b_lon from {EDGE_SQL} e0 where seq < 5)"
VERTEX_IN = f"""(select v.poly_id p, e.poly_id q from (select poly_id, seq, lat, lon from poly_vertex) v join {EDGE_SQL} e on e.poly_id<>v.poly_id group by v.poly_id, v.seq, e.poly_id
   having sum(case when (e.lo > v.lon) <> (e.lob > v.lon) and v.lat < (e.lb-e.la)*(v.lon-e.lo)/(e.lob-e.lo)+e.la then 1 else 0 end) % 2 = 1)"""
CROSS = f"""(select x.poly_id p, y.poly_id q from {SELF_EDGES} x join (select poly_id, a_lat c_lat, a_lon c_lon, b_lat d_lat, b_lon d_lon from {SELF_EDGES} s) y on x.poly_id<y.poly_id and {crossing_sql()})"""
MEET = f"(select distinct least(p,q) a, greatest(p,q) b from (select * from {VERTEX_IN} i union all select * from {CROSS} c) m)"


@query("polygons_intersect", f"select a, b from {MEET} m")
def polygons_intersect(t):
    pairs = sj.polygon_edges(t.polygons, "poly_id")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("polygon_components", f"""with recursive m as materialized (select * from {MEET} m0), e as materialized (select a x, b y from m union select b, a from m),
    reach as (select distinct poly_id s, poly_id v from poly_vertex union select r.s, e.y from reach r join e on e.x=r.v) select s poly_id, min(v) component from reach group by s""")
def polygon_components(t):
    return sj.polygon_components(t.polygons, "poly_id")


def spread_heights(t):
    """Heights on cells all over the grid at any scale."""
    place = F.col("o_orderkey") * 17 % (GRID.rows * GRID.cols)
    return t.orders.select(big(F.floor(place / GRID.cols)).alias("r"), (place % GRID.cols).alias("c"), (F.col("o_totalprice") / 10000.0).alias("z")).groupBy("r", "c").agg(F.min("z").alias("z"))


@query("engineered_ground")
def engineered_ground(t):
    from ..operators.ground import engineered_ground

    out = engineered_ground(areas(t), spread_heights(t), GRID)
    return out.select("r", "c", F.round("level_m", 6).alias("level_m"), F.round("strength", 6).alias("strength"))
