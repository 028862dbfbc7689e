"""Queries for positions, proximity and links."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.geo import big
from ..operators import motion as mo, rivers
from ..operators.inference import cumulative_distance, points_along_line
from .catalog import query
from .scalars import case_sql, haversine_sql

# States in metres, half a minute apart in the given data; ms are squeezed so that gaps around half a second occur.
STATES = """(select user_id peer, event_id seq, ts, cast(event_id*190 as bigint) ms, value*0.001e0 x, (event_id % 7)*0.01e0 y, (event_id % 3)*0.02e0 z, 0.5e0 vx, -0.25e0 vy, 0.125e0 vz,
   (event_id % 11)*0.003e0 yaw, (event_id % 5)*0.002e0 pitch, case when event_type='view' then 'walk' else 'fly' end mode from events)"""


def states(t):
    return t.sql(f"select * from {STATES} s")


# Dense rows of one group of peers, where most rows are near the last kept one.
DENSE = """(select event_id % 8 peer, event_id seq, cast(event_id*20 + (event_id % 97)*3 + cast(floor(event_id/400e0) as bigint)*700 as bigint) ms, (event_id % 5)*0.004e0 x, 0e0 y, 0e0 z,
   cast(floor((event_id % 300)/100e0) as double)*0.02e0 yaw, 0e0 pitch, case when event_id % 701 < 350 then 'walk' else 'fly' end mode from events)"""


@query("delta_filter", f"""with recursive o as materialized (select *, row_number() over (partition by peer order by seq) k from {DENSE} d),
   run as (select peer, seq, k, x, yaw, mode, ms, true keep, x lx, yaw lyaw, mode lmode, ms lms from o where k=1
    union all select peer, seq, k, x, yaw, mode, ms, hit, case when hit then x else lx end, case when hit then yaw else lyaw end, case when hit then mode else lmode end, case when hit then ms else lms end from
    (select o.*, r.lx, r.lyaw, r.lmode, r.lms, abs(o.x-r.lx)>0.05e0 or abs(o.yaw-r.lyaw)>0.017e0 or o.mode<>r.lmode or o.ms-r.lms>=500 hit from run r join o on o.peer=r.peer and o.k=r.k+1) q)
   select peer, seq from run where keep""")
def delta_filter(t):
    return mo.delta_filter(t.sql(f"select * from {DENSE} d")).select("peer", "seq")


@query("staleness", "select user_id peer, max(ts) last_ts, date_diff('millisecond', max(ts), timestamp '2024-02-01 12:00:00')>5000 stale from events group by user_id")
def staleness(t):
    return mo.staleness(states(t), F.lit("2024-02-01 12:00:00").cast("timestamp"))


@query("presence_sessions", """select peer, min(ts) as "start", max(ts) as "end", count(*) n from (select *, sum(case when gap is null or gap>=7200000000 then 1 else 0 end) over (partition by peer order by ts, event_id) s from
   (select user_id peer, ts, event_id, date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) gap from events) q) z group by peer, s""")
def presence_sessions(t):
    return mo.presence_sessions(states(t), gap="2 hours")


@query("lag_motion", f"""select peer, seq, round(sqrt(power(x-px,2e0)+power(y-py,2e0)+power(z-pz,2e0)),7) moved_m, round(abs(yaw-pyaw),7) turned from (select *, lag(x) over w px, lag(y) over w py, lag(z) over w pz, lag(yaw) over w pyaw from {STATES} s
   window w as (partition by peer order by ts, seq)) q""")
def lag_motion(t):
    out = mo.lag_motion(states(t))
    return out.select("peer", "seq", F.round("moved_m", 7).alias("moved_m"), F.round("turned", 7).alias("turned"))


ASKS = "(select user_id peer, event_id ask_id, ts + interval '30' minute ts from events where event_type='click')"


@query("as_of_states", f"""with s as (select peer, seq, epoch_us(ts)//1000 ms, x, vx, yaw from {STATES} s0), a as (select peer, ask_id, epoch_us(ts)//1000-100 ms from {ASKS} a0),
   j as (select a.peer, a.ask_id, a.ms t, p.ms pm, p.x px, p.vx pvx, p.yaw pyaw, n.ms nm, n.x nx, n.yaw nyaw from a left join lateral (select * from s where s.peer=a.peer and s.ms<=a.ms order by s.ms desc, seq desc limit 1) p on true
     left join lateral (select * from s where s.peer=a.peer and s.ms>a.ms order by s.ms, seq limit 1) n on true)
   select peer, ask_id, case when pm is not null and nm is not null then 'between' when pm is not null then 'ahead' else 'first' end how, round(case when pm is null then nx when nm is null then px+pvx*(t-pm)/1000e0 else px+(nx-px)*((t-pm)/cast(nm-pm as double)) end,6) x,
     round(case when pm is null then nyaw when nm is null then pyaw else pyaw+(nyaw-pyaw)*((t-pm)/cast(nm-pm as double)) end,9) yaw from j""")
def as_of_states(t):
    out = mo.as_of_states(states(t), t.sql(f"select * from {ASKS} a"))
    return out.select("peer", "ask_id", "how", F.round("x", 6).alias("x"), F.round("yaw", 9).alias("yaw"))


@query("region_change", """select event_id, x, y from (select event_id, x, y, lag(x) over w px, lag(y) over w py from (select *, cast(floor(lon/0.01e0) as bigint) x, cast(floor(lat/0.01e0) as bigint) y from position) p
   window w as (partition by peer order by ts, event_id)) q where px is null or px<>x or py<>y""")
def region_change(t):
    out = mo.region_change(t.position, order=("ts", "event_id"))
    return out.select("event_id", F.col("region.x").alias("x"), F.col("region.y").alias("y"))


@query("region_fanout", """select subscriber, count(*) n from (select s.site_id subscriber, p.event_id from (select *, cast(floor(lon/0.01e0) as bigint) x, cast(floor(lat/0.01e0) as bigint) y from site) s
   join (select *, cast(floor(lon/0.01e0) as bigint) x, cast(floor(lat/0.01e0) as bigint) y from position) p on abs(s.x-p.x)<=1 and abs(s.y-p.y)<=1) q group by subscriber""")
def region_fanout(t):
    subs = t.site.select(F.col("site_id").alias("subscriber"), "lat", "lon")
    return mo.fanout_counts(mo.routed(t.position.select("event_id", "lat", "lon")), subs)


# Peers on a plane with crowded and empty places.
PEERS = """(select c_custkey peer, (c_custkey*37 % 211)*(c_custkey % 9)*23e0 x, (c_custkey*53 % 199)*(c_custkey % 5)*31e0 y, (c_custkey % 3)*15e0 z, c_custkey % 20=0 is_relay from customer)"""
OBSERVERS = f"(select peer, x, y, z from {PEERS} p where is_relay)"


def peers(t):
    return t.sql(f"select * from {PEERS} p")


DIST = f"(select o.peer observer, p.peer, sqrt(power(o.x-p.x,2e0)+power(o.y-p.y,2e0)+power(o.z-p.z,2e0)) d, p.is_relay from {OBSERVERS} o join {PEERS} p on p.peer<>o.peer)"
TIER_SQL = "cast(case when d<=100 then 1 when d<=500 then 2 when d<=1000 then 3 else 4 end as bigint)"


@query("proximity_pairs", f"select observer, peer, round(d,5) dist_m, {TIER_SQL} tier from {DIST} q where d<=1000")
def proximity_pairs(t):
    p = peers(t)
    return mo.proximity_pairs(p.where("is_relay"), p, digits=5)


@query("tier_counts", f"select observer, count(*) filter (d<=100) tier1, count(*) filter (d>100 and d<=500) tier2, count(*) filter (d>500 and d<=1000) tier3, count(*) filter (d>1000) tier4, (select count(*) from {PEERS} p where is_relay) relays from {DIST} q group by observer")
def tier_counts(t):
    p = peers(t)
    return mo.tier_counts(p.where("is_relay"), p)


@query("tiered_top_k", f"select observer, peer, round(d,5) dist_m, tier, rank from (select *, {TIER_SQL} tier, row_number() over (partition by observer order by {TIER_SQL}, d, peer) rank from {DIST} q) z where rank<=5")
def tiered_top_k(t):
    p = peers(t)
    return mo.tiered_top_k(p.where("is_relay"), p).withColumn("dist_m", F.round("dist_m", 5))


@query("sample_fraction", "select cast(ceil(count(*)*0.2e0) as bigint) n from customer")
def sample_fraction(t):
    out = mo.sample_fraction(t.customer.select("c_custkey"), "c_custkey", 0.2, 7)
    return out.agg(F.count_distinct("c_custkey").alias("n"))


@query("rtt_median5", """select link, seq, v[len(v)//2+1] median_ms from (select link, seq, list_sort(list(rtt_ms) over (partition by link order by seq rows between 4 preceding and current row)) v from rtt) q""")
def rtt_median5(t):
    return mo.rtt_median5(t.rtt, 100).select("link", "seq", "median_ms")


RANKS = "case {x} when 'LAN' then 0 when 'Constrained' then 2 else 1 end"


@query("link_profile", f"""with recursive c as materialized (select link, seq, case when m<5 then 'LAN' when m<50 then 'Normal' else 'Constrained' end cand from (select link, seq, v[len(v)//2+1] m from (select link, seq, list_sort(list(rtt_ms) over (partition by link order by seq rows between 4 preceding and current row)) v from
     (select link, seq, case when link % 2=0 then rtt_ms/12e0 else rtt_ms end rtt_ms from rtt) r) q) z),
   run as (select link, cast(0 as bigint) seq, 'Auto' profile, 0 streak from (select distinct link from c) l
    union all select c.link, c.seq, case when {RANKS.format(x='c.cand')} > {RANKS.format(x='r.profile')} then c.cand when {RANKS.format(x='c.cand')} < {RANKS.format(x='r.profile')} and r.streak=2 then c.cand else r.profile end,
      case when {RANKS.format(x='c.cand')} < {RANKS.format(x='r.profile')} and r.streak<2 then r.streak+1 else 0 end from run r join c on c.link=r.link and c.seq=r.seq+1)
   select link, seq, profile from run where seq>0""")
def link_profile(t):
    s = t.rtt.withColumn("rtt_ms", F.when(F.col("link") % 2 == 0, F.col("rtt_ms") / 12.0).otherwise(F.col("rtt_ms")))
    return mo.link_profile(s, 150).select("link", "seq", "profile")


@query("message_gate", f"""select id, hz position_hz from (select o_orderkey id, case o_orderkey % 5 when 0 then 'LoRa' when 1 then 'Constrained' when 2 then 'Normal' when 3 then 'LAN' else 'Auto' end profile, o_custkey % 4 p from orders) m,
   lateral (select {case_sql('profile', mo.MAX_PRIORITY)} top, cast({case_sql('profile', mo.POSITION_HZ)} as double) hz) k where p<=top""")
def message_gate(t):
    k = F.col("o_orderkey") % 5
    profile = F.element_at(F.array(*[F.lit(p) for p in ("LoRa", "Constrained", "Normal", "LAN", "Auto")]), (k + 1).cast("int"))
    priority = F.element_at(F.array(*[F.lit(p) for p in mo.PRIORITY]), (F.col("o_custkey") % 4 + 1).cast("int"))
    msgs = t.orders.select(F.col("o_orderkey").alias("id"), profile.alias("profile"), priority.alias("priority"))
    return mo.message_gate(msgs).select("id", "position_hz")


@query("op_rate_windows", "select user_id author, to_timestamp(floor(epoch(ts)/3600)*3600)::timestamp as start_ts, count(*) n from events group by 1, 2")
def op_rate_windows(t):
    out = t.events.groupBy(F.col("user_id").alias("author"), F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("author", F.col("w.start").alias("start_ts"), "n")


# ---------------------------------------------------------------------------------------------------------
# Lines
# ---------------------------------------------------------------------------------------------------------
CUM = f"(select *, coalesce({haversine_sql('plat', 'plon', 'lat', 'lon')},0e0) seg_m from (select *, lag(lat) over w plat, lag(lon) over w plon from line_vertex window w as (partition by line_id order by seq)) q)"


@query("cumulative_distance", f"select line_id, seq, round(sum(seg_m) over (partition by line_id order by seq),4) cum_m from {CUM} c")
def cumulative_distance_q(t):
    return cumulative_distance(t.line_vertex, ["line_id"]).select("line_id", "seq", F.round("cum_m", 4).alias("cum_m"))


@query("points_along_line", f"""select line_id, k, round(plat+((k*30e0+15e0-(cum-seg_m))/seg_m)*(lat-plat),8) lat, round(plon+((k*30e0+15e0-(cum-seg_m))/seg_m)*(lon-plon),8) lon from (select *, sum(seg_m) over (partition by line_id order by seq) cum from {CUM} c) c,
   lateral (select unnest(range(cast(greatest(ceil((cum-seg_m-15e0)/30e0),0) as bigint), cast(ceil((cum-15e0)/30e0) as bigint))) k) r where seg_m>=0.1e0""")
def points_along_line_q(t):
    out = points_along_line(t.line_vertex, ["line_id"])
    return out.select("line_id", "k", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


TURNED = """(select line_id, lat, lon, elev, case when f<l then 5-seq else seq end seq from line_vertex join (select line_id, max(case when seq=1 then elev end) f, max(case when seq=4 then elev end) l from line_vertex group by line_id) e using (line_id))"""
BUMPY = TURNED.replace("line_vertex", "(select line_id, seq, lat, lon, elev*(case line_id % 3 when 0 then -1e0 else 1e0 end)+(seq*7 % 3)*8e0 elev from line_vertex)")


def bumpy(t):
    sign = F.when(F.col("line_id") % 3 == 0, -1.0).otherwise(1.0)
    return t.line_vertex.withColumn("elev", F.col("elev") * sign + (F.col("seq") * 7 % 3) * 8.0)


@query("monotone_profile", f"select line_id, seq, round(min(elev) over (partition by line_id order by seq),6) water_m from {BUMPY} b")
def monotone_profile(t):
    return rivers.monotone_profile(bumpy(t)).select("line_id", "seq", F.round("water_m", 6).alias("water_m"))


KIND = "(case line_id % 3 when 0 then 'river' when 1 then 'stream' else 'canal' end)"


@query("river_profile", f"""with v as (select line_id, seq, lat, lon, min(elev) over (partition by line_id order by seq) w from {BUMPY} b), d as (select *, sum(coalesce({haversine_sql('plat', 'plon', 'lat', 'lon')},0e0)) over (partition by line_id order by seq) cum from
     (select *, lag(lat) over k plat, lag(lon) over k plon from v window k as (partition by line_id order by seq)) q),
   e as (select line_id, greatest(max(cum),1e0) len, arg_max(w,seq) mouth, arg_min(w,seq) src from d group by line_id)
   select line_id, seq, tidal is_tidal, round(least(greatest(bw*least(greatest((seq*2e0)/8e0,0.5e0),3e0)*(1+2*frac),0.5e0),200e0),6) half_width_m,
     round(least(greatest(bd*(1+1.5e0*frac)*(1-least(greatest(4e0/30e0,0e0),0.9e0))*(case when tidal then 1.5e0 else 1e0 end),0.3e0),25e0),6) depth_m from
   (select d.line_id, seq, cum/len frac, mouth<5 and greatest(src-mouth,0e0)/len*100<0.01e0 and (d.line_id*700e0)<15000 and {KIND.replace('line_id', 'd.line_id')}='river' tidal,
     case {KIND.replace('line_id', 'd.line_id')} when 'river' then 8e0 when 'canal' then 6e0 else 2e0 end bw, case {KIND.replace('line_id', 'd.line_id')} when 'river' then 2e0 when 'canal' then 2.5e0 else 0.8e0 end bd from d join e on e.line_id=d.line_id) z""")
def river_profile(t):
    kind = F.when(F.col("line_id") % 3 == 0, "river").when(F.col("line_id") % 3 == 1, "stream").otherwise("canal")
    # The moisture value follows the turned position, so it is set after turning by a join on the line's direction.
    turned = rivers.monotone_profile(bumpy(t)).select("line_id", "seq", "lat", "lon", "elev", kind.alias("waterway"),
                                                     (F.col("seq") * 2.0).alias("twi"), F.lit(4.0).alias("slope_deg"), (F.col("line_id") * 700.0).alias("coast_m"))
    out = rivers.river_profile(turned)
    return out.select("line_id", "seq", "is_tidal", F.round("half_width_m", 6).alias("half_width_m"), F.round("depth_m", 6).alias("depth_m"))
