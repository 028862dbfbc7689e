"""Queries for height lookups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import big
from ..operators import elevation as el
from ..operators.skew import pick_rank
from ..operators.spatial_join import Grid
from .catalog import query

# Height cells as a grid in degrees under the positions; its rows follow the table.
BILINEAR = """with p as (select event_id, (lat+27.7e0)/0.002e0 fr, (lon-152.9e0)/0.002e0 fc from position),
   k as (select event_id, least(greatest(floor(fr)+i,0),(select max(r) from dem_cell)) r, least(greatest(floor(fc)+j,0),124) c, (case when i=1 then fr-floor(fr) else 1-(fr-floor(fr)) end)*(case when j=1 then fc-floor(fc) else 1-(fc-floor(fc)) end) w from p, range(2) a(i), range(2) b(j))
   select event_id, round(case when count(*)=4 then sum(z*w) else avg(z) end,6) z from k join dem_cell d on d.r=k.r and d.c=k.c group by event_id"""


def grid(t):
    return Grid(-27.7, 152.9, 0.002, (t.dem_cell.agg(F.max("r")).first()[0] or 0) + 1, 125)


@query("dem_bilinear", BILINEAR)
def dem_bilinear(t):
    return el.dem_bilinear(t.position, t.dem_cell, grid(t), ["event_id"]).select("event_id", F.round("z", 6).alias("z"))


# Elevation tiles of 41 x 41 pixels from order prices, with voids; two tiles, one is left out.
SIDE = 41
TILE_SQL = """(select cast(-28 as bigint) tile_lat, cast(153 as bigint) tile_lon, cast(floor(k/41e0) as bigint) prow, k % 41 pcol,
   case when floor(k/41e0)>=28 and k % 41>=4 and k % 41<=7 then -32768 when k % 29 = 0 then -9999 else cast(floor(v/3000e0) as bigint)+(k % 41)*3 end elev_m from
   (select o_orderkey % 1681 k, max(o_totalprice) v from orders group by o_orderkey % 1681) q)"""


def tiles(t):
    return t.sql(f"select * from {TILE_SQL} q")


SAMPLE_SQL = f"""with tl as materialized (select * from {TILE_SQL} q), p as (select event_id, lat, lon, (-27e0-lat)*40e0 fr, (lon-153e0)*40e0 fc from position where floor(lat)=-28 and floor(lon)=153),
   q as (select *, least(greatest(cast(floor(fr) as bigint),0),39) r0, least(greatest(cast(floor(fc) as bigint),0),39) c0 from p),
   c as (select q.event_id, r0, c0, fr-r0 rf, fc-c0 cf, max(case when prow=r0 and pcol=c0 then elev_m end) e00, max(case when prow=r0 and pcol=c0+1 then elev_m end) e01, max(case when prow=r0+1 and pcol=c0 then elev_m end) e10,
     max(case when prow=r0+1 and pcol=c0+1 then elev_m end) e11, count(elev_m) n, avg(elev_m) m from q left join tl on prow between r0 and r0+1 and pcol between c0 and c0+1 and elev_m not in (-32768,-9999) group by q.event_id, r0, c0, fr, fc),
   f as (select c.event_id, min(elev_m) z from c join tl on prow between r0-8 and r0+8 and pcol between c0-8 and c0+8 and elev_m not in (-32768,-9999) where n=0 group by c.event_id)
   select c.event_id, round(coalesce(case when n=4 then case when {{cliff}} then case when rf<0.5 then case when cf<0.5 then e00 else e01 end else case when cf<0.5 then e10 else e11 end end
     else (e00*(1-cf)+e01*cf)*(1-rf)+(e10*(1-cf)+e11*cf)*rf end when n>0 then m end, f.z, 0e0),6) z from c left join f on f.event_id=c.event_id"""
CLIFF = "greatest(abs(e00-e01),abs(e00-e10),abs(e01-e11),abs(e10-e11))>15"


@query("dem_sample", SAMPLE_SQL.format(cliff=CLIFF))
def dem_sample(t):
    return el.dem_sample(t.position, tiles(t), ["event_id"], SIDE).select("event_id", F.round("z", 6).alias("z"))


@query("dem_sample_smooth", SAMPLE_SQL.format(cliff="false"))
def dem_sample_smooth(t):
    return el.dem_sample(t.position, tiles(t), ["event_id"], SIDE, None).select("event_id", F.round("z", 6).alias("z"))


# A point table with gaps: heights exist only for even tenths of a degree cell.
KNOWN = "(select cast(floor(lat*7200e0) as bigint) ky, cast(floor(lon*7200e0) as bigint) kx, avg(alt) z from position where event_id % 2 = 0 group by 1, 2)"


@query("dem_fill_neighbours", f"""with k as materialized (select * from {KNOWN} q), p as (select event_id, lat, lon from position),
   raw as (select event_id, k.z from p join k on ky=floor(lat*7200e0) and kx=floor(lon*7200e0)),
   miss as (select * from p where event_id not in (select event_id from raw))
   select event_id, round(z+1.5e0,6) z from raw union all select event_id, round(avg(k.z)+1.5e0,6) z from miss, (select {el.FILL_STEP_DEG!r} dy, 0e0 dx union all select -{el.FILL_STEP_DEG!r}, 0e0 union all select 0e0, {el.FILL_STEP_DEG!r} union all select 0e0, -{el.FILL_STEP_DEG!r}) o
     join k on true where ky=floor((lat+dy)*7200e0) and kx=floor((lon+dx)*7200e0) group by event_id""")
def dem_fill_neighbours(t):
    known = t.sql(f"select * from {KNOWN} q")

    def sample(points, ids):
        keyed = points.withColumn("ky", big(F.floor(F.col("lat") * 7200.0))).withColumn("kx", big(F.floor(F.col("lon") * 7200.0)))
        return keyed.join(known, ["ky", "kx"]).select(*ids, "z")

    return el.dem_fill_neighbours(t.position, sample, ["event_id"], 1.5).select("event_id", F.round("z", 6).alias("z"))


@query("dem_source_priority", """select event_id, case when event_id % 3=0 then round(alt,6) when event_id % 5=0 then round(lat,6) end z,
    cast(case when event_id % 3=0 then 0 when event_id % 5=0 then 1 end as bigint) source from position""")
def dem_source_priority(t):
    first = t.position.where(F.col("event_id") % 3 == 0).select("event_id", F.col("alt").alias("z"))
    second = t.position.where(F.col("event_id") % 5 == 0).select("event_id", F.col("lat").alias("z"))
    return el.dem_source_priority(t.position, [first, second], ["event_id"]).select("event_id", F.round("z", 6).alias("z"), "source")


RAW_Z = "(select 'R0' region, r, c, case when (r+c) % 37=0 then -32768e0 when (r*c) % 41=0 then 12000e0 else z-20e0 end z from dem_cell)"


@query("dem_range", f"select region, round(min(z),5) z_min, round(max(z),5) z_max from {RAW_Z} q where z>-1000 and z<10000 group by region")
def dem_range(t):
    out = el.dem_range(t.sql(f"select * from {RAW_Z} q"))
    return out.select("region", F.round("z_min", 5).alias("z_min"), F.round("z_max", 5).alias("z_max"))


@query("dem_plausible", f"select r, c from {RAW_Z} q where z>-1000 and z<10000")
def dem_plausible(t):
    return t.sql(f"select * from {RAW_Z} q").where(rules.dem_plausible("z")).select("r", "c")


DATUM = "(select 'R'||cast(r % 7 as {s}) region, -30e0+r*0.01e0 lat, 150e0+c*0.02e0 lon, z/10e0-4e0 z, -30e0 lat_min, -29e0+0.2e0 lat_max, 150e0 lon_min, 152.48e0 lon_max from dem_cell)"


@query("datum_offset", f"""select region, round(z,6) median_m, round(case when z>-8 and z<12 then -z else 0e0 end,6) offset_m from (select region, z, row_number() over (partition by region order by z) rn, count(*) over (partition by region) n
    from {DATUM.format(s='varchar')} q where z>=-50 and (z<20 or lat<lat_min+0.5 or lat>lat_max-0.5 or lon<lon_min+0.5 or lon>lon_max-0.5)) k where rn=least(greatest(n//50,1),30)//2+1""")
def datum_offset(t):
    out = el.datum_offset(t.sql(f"select * from {DATUM.format(s='string')} q"))
    return out.select("region", F.round("median_m", 6).alias("median_m"), F.round("offset_m", 6).alias("offset_m"))


@query("sample_region", """select r, c, round(coalesce(z,0e0),6) z from (select r.range r, c.range c from range(31) r, range(26) c) g left join
    (select cast(floor((lat+27.6e0)/0.01e0+0.5e0) as bigint) kr, cast(floor((lon-153e0)/0.008e0+0.5e0) as bigint) kc, avg(alt) z from position group by 1, 2) k on kr=r and kc=c""")
def sample_region(t):
    known = t.position.groupBy(big(F.floor((F.col("lat") + 27.6) / 0.01 + 0.5)).alias("r"), big(F.floor((F.col("lon") - 153.0) / 0.008 + 0.5)).alias("c")).agg(F.avg("alt").alias("z"))
    grid = Grid(-27.6, 153.0, 0.01, 31, 26)
    cells_ = el.grid_cells(t.spark, grid)
    return cells_.join(known, ["r", "c"], "left").select("r", "c", F.round(F.coalesce("z", F.lit(0.0)), 6).alias("z"))


UP = """select x, y, round(case when step>4 then case when fi<0.5 then case when fj<0.5 then e00 else e01 end else case when fj<0.5 then e10 else e11 end end
   else (e00*(1-fj)+e01*fj)*(1-fi)+(e10*(1-fj)+e11*fj)*fi end,9) z from (select a.r*5+p x, a.c*5+q y, p/5e0 fi, q/5e0 fj, a.z/20e0 e00, b.z/20e0 e01, c.z/20e0 e10, d.z/20e0 e11,
   greatest(abs(a.z-b.z),abs(a.z-c.z),abs(b.z-d.z),abs(c.z-d.z))/20e0 step from dem_cell a join dem_cell b on b.r=a.r and b.c=a.c+1 join dem_cell c on c.r=a.r+1 and c.c=a.c join dem_cell d on d.r=a.r+1 and d.c=a.c+1, range(5) x(p), range(5) y(q)) k"""


@query("upsample_grid", UP)
def upsample_grid(t):
    samples = t.dem_cell.select("region", F.col("r").alias("i"), F.col("c").alias("j"), (F.col("z") / 20.0).alias("z"))
    return el.upsample_grid(samples, 5).select("x", "y", F.round("z", 9).alias("z"))


@query("scalar_stats", """select category, min(z) z_min, max(z) z_max, round(avg(z),6) z_mean, max(case when rn=r95 then z end) p95 from (select p_type category, p_retailprice z, row_number() over (partition by p_type order by p_retailprice) rn,
    cast(round((count(*) over (partition by p_type)-1)*0.95e0) as bigint)+1 r95 from part) q group by category""")
def scalar_stats(t):
    from ..operators.aggregates import scalar_stats

    df = t.part.select(F.col("p_type").alias("category"), F.col("p_retailprice").alias("z"))
    out = scalar_stats(df, ["category"], "z")
    return out.select("category", "z_min", "z_max", F.round("z_mean", 6).alias("z_mean"), F.col("z_p95").alias("p95"))
