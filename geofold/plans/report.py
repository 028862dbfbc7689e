"""Queries for the control report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import big
from ..operators import aggregates as ag, report as rp
from .catalog import query

# Sites of the report: a small image per site, references on some.
SITES = "(select site_id, category, lat, lon, 240e0 window_m, cast(5+site_id % 3 as bigint) image_size, alt/50e0 reference_m, case when site_id % 4=0 then 'survey_context' else 'survey' end reference_status from site)"
WIN = f"(select site_id, category, r.range r, c.range c, image_size from {SITES} s, range(7) r, range(7) c where r.range<image_size and c.range<image_size)"
CELLS = f"(select *, (site_id*31+r*17+c*13) % 101*0.7e0 source_m, (site_id*31+r*17+c*13) % 101*0.7e0+case when site_id % 3=0 and r=c then 1.5e0 else 0e0 end generated_m, site_id % 3=0 and r=c engineered, site_id % 3=1 and r=0 context from {WIN} w)"


def sites(t):
    return t.sql(f"select * from {SITES} s")


def windows(t):
    w = rp.control_windows(sites(t))
    k = F.col("site_id")
    src = (k * 31 + F.col("r") * 17 + F.col("c") * 13) % 101 * 0.7
    eng = (k % 3 == 0) & (F.col("r") == F.col("c"))
    return w.withColumn("source_m", src).withColumn("generated_m", src + F.when(eng, 1.5).otherwise(0.0)).withColumn("engineered", eng).withColumn("context", (k % 3 == 1) & (F.col("r") == 0))


@query("control_windows", f"""select w.site_id, r, c, round(lat+120e0/111320e0-(240e0/111320e0)*r/(w.image_size-1),9) lat,
   round(lon-120e0/(111320e0*greatest(abs(cos(radians(lat))),0.1e0))+(240e0/(111320e0*greatest(abs(cos(radians(lat))),0.1e0)))*c/(w.image_size-1),9) lon from {WIN} w join site s on s.site_id=w.site_id""")
def control_windows(t):
    return rp.control_windows(sites(t)).select("site_id", "r", "c", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


METRICS = f"""(select s.site_id, s.category, min(generated_m) lo, max(generated_m) hi, max(case when rn=cast(round((n-1)*0.95e0) as bigint)+1 then generated_m end) p95, count(*) filter (abs(generated_m-source_m)>1e-6) changed,
   count(*) filter (engineered) eng, count(*) filter (context) ctx, max(case when r=s.image_size//2 and c=s.image_size//2 and reference_status not like '%!_context' escape '!' then generated_m-reference_m end) ref_delta
   from (select *, row_number() over (partition by site_id order by generated_m) rn, count(*) over (partition by site_id) n from {CELLS} k) k join {SITES} s on s.site_id=k.site_id group by s.site_id, s.category)"""


@query("control_metrics", f"""select site_id, round(hi-lo,6) span_m, round(p95,6) p95_m, changed, round(ref_delta,6) reference_delta_m, case when eng>0 then 'engineered_ground_active' when ctx>0 then 'osm_context_only' else 'dem_only' end coverage from {METRICS} m""")
def control_metrics(t):
    m = rp.control_metrics(sites(t), windows(t))
    return m.select("site_id", F.round("span_m", 6).alias("span_m"), F.round("generated_m_p95", 6).alias("p95_m"), "changed", F.round("reference_delta_m", 6).alias("reference_delta_m"), "coverage")


@query("category_aggregate", f"""select category, count(*) sites, round(avg(hi-lo),5) mean_span_m, round(avg(p95),5) mean_p95_m, count(*) filter (eng>0) engineered_sites, count(*) filter (eng=0 and ctx>0) context_sites from {METRICS} m group by category""")
def category_aggregate(t):
    a = rp.category_aggregate(rp.control_metrics(sites(t), windows(t)))
    return a.withColumn("mean_span_m", F.round("mean_span_m", 5)).withColumn("mean_p95_m", F.round("mean_p95_m", 5))


@query("category_warnings", "select n_nationkey category, cast(n_nationkey % 6 as bigint) expected_min, count(site_id) sites from nation left join site on category=n_nationkey group by n_nationkey having count(site_id)<n_nationkey % 6")
def category_warnings(t):
    have = t.site.groupBy("category").agg(F.count(F.lit(1)).alias("sites"))
    want = t.nation.select(F.col("n_nationkey").alias("category"), big(F.col("n_nationkey") % 6).alias("expected_min"))
    return rp.category_warnings(have, want)


@query("coverage_mode", f"select coverage, count(*) n from (select case when eng>0 then 'engineered_ground_active' when ctx>0 then 'osm_context_only' else 'dem_only' end coverage from {METRICS} m) q group by coverage")
def coverage_mode(t):
    w = windows(t).groupBy("site_id").agg(F.count_if("engineered").alias("e"), F.count_if("context").alias("c"))
    return w.groupBy(ag.coverage_mode("e", "c").alias("coverage")).agg(F.count(F.lit(1)).alias("n"))


@query("changed_fraction", f"select site_id, count(*) filter (abs(generated_m-source_m)>1e-6) changed, round(count(*) filter (abs(generated_m-source_m)>1e-6)/cast(count(*) as double),8) fraction from {CELLS} k group by site_id")
def changed_fraction(t):
    return ag.changed_fraction(windows(t), "source_m", "generated_m", ["site_id"]).withColumn("fraction", F.round("fraction", 8))


@query("reference_usable", f"select site_id from {SITES} s where reference_status='survey'")
def reference_usable(t):
    return sites(t).where(rules.reference_usable("reference_status")).select("site_id")


BAKED = "(select c vx, r vz, z surface_y from dem_cell where (r*7+c*11) % 5<>0)"


@query("surface_sampling", f"""with s as (select s_suppkey site_id, s_suppkey*3 % 100 vx0, s_suppkey*7 % 90 vz0 from supplier), p as (select site_id, i.range i, j.range j, floor(vx0+(i.range+0.5e0)*20/4e0) x, floor(vz0+(j.range+0.5e0)*20/4e0) z from s, range(4) i, range(4) j)
   select site_id, i, j, vx, vz, surface_y from (select p.*, b.*, row_number() over (partition by site_id, i, j order by power(vx-x,2)+power(vz-z,2), vx, vz) rn from p join {BAKED} b on abs(vx-x)<=3 and abs(vz-z)<=3) q where rn=1""")
def surface_sampling(t):
    s = t.supplier.select(F.col("s_suppkey").alias("site_id"), (F.col("s_suppkey") * 3 % 100).alias("vx0"), (F.col("s_suppkey") * 7 % 90).alias("vz0"), F.lit(20).alias("size"))
    return rp.surface_sampling(s, t.sql(f"select * from {BAKED} b"), 4, 3)
