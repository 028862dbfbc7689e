"""Queries for the edit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import big
from ..operators import oplog as ol
from .catalog import query
from .scalars import case_sql

WIN = "(select vx, vy, vz, op_id, author, lamport, material from op_log qualify row_number() over (partition by vx, vy, vz order by lamport desc, author desc, op_id desc)=1)"


@query("lww_register", f"select * from {WIN} w")
def lww_register(t):
    return ol.lww_register(t.op_log)


@query("dedup_signature", "select author, count(distinct op_id % 500) n from op_log group by author")
def dedup_signature(t):
    ops = t.op_log.select((F.col("op_id") % 500).alias("sig"), "author", "lamport")
    kept = ol.dedup_signature(ops.withColumn("sig", F.struct("author", "sig")), "sig")
    return kept.groupBy("author").agg(F.count(F.lit(1)).alias("n"))


CHUNKED = """(select distinct op_id, author, lamport, material, vx, vy, vz, cast(floor((vx+dx)/30e0) as bigint) cx, cast(floor((vy+dy)/200e0) as bigint) cy, cast(floor((vz+dz)/30e0) as bigint) cz
   from op_log, (select -1 dx union all select 0) a, (select -1 dy union all select 0) b, (select -1 dz union all select 0) c)"""


@query("replay_order", f"select cx, cy, cz, op_id, row_number() over (partition by cx, cy, cz order by lamport, author, op_id) pos from {CHUNKED} q")
def replay_order(t):
    out = ol.replay_order(ol.ops_by_chunk(t.op_log), ["cx", "cy", "cz"], F.floor(F.col("lamport") / 1000))
    return out.select("cx", "cy", "cz", "op_id", "pos")


@query("state_catch_up", f"""with req as (select n_nationkey request_id, cast(k as bigint) seq, cast(k % 2 - 1 as bigint) cx, cast(0 as bigint) cy, cast(n_nationkey % 2 - k // 2 as bigint) cz from nation, range(3) r(k)),
   hit as (select r.request_id, c.op_id, r.seq, c.cx, c.cy, c.cz, c.lamport, c.author, row_number() over (partition by r.request_id, c.op_id order by r.seq) rn from req r join {CHUNKED} c on c.cx=r.cx and c.cy=r.cy and c.cz=r.cz)
   select cast(request_id as bigint) request_id, op_id, seq, pos, cast((pos-1)//100 as bigint) page from (select *, row_number() over (partition by request_id order by lamport, author, op_id) pos from hit where rn=1) q""")
def state_catch_up(t):
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    req = t.nation.select(big(F.col("n_nationkey")).alias("request_id"), k.alias("k")).select(
        "request_id", big(F.col("k")).alias("seq"), big(F.col("k") % 2 - 1).alias("cx"), F.lit(0).cast("bigint").alias("cy"),
        big(F.col("request_id") % 2 - F.floor(F.col("k") / 2)).alias("cz"))
    out = ol.state_catch_up(t.op_log, req)
    return out.select("request_id", "op_id", "seq", "pos", "page")


@query("write_op_chunks", f"select op_id, author, lamport, material, vx, vy, vz, cx, cy, cz from {CHUNKED} q")
def write_op_chunks(t):
    from ..session import shared_dir
    from ..sources import sinks

    path = sinks.new_folder(shared_dir(t.spark), "op-chunks")
    sinks.write_op_chunks(t.op_log, path)
    return t.spark.read.parquet(path).select("op_id", "author", "lamport", "material", "vx", "vy", "vz", *[big(F.col(c)).alias(c) for c in ("cx", "cy", "cz")])


# Actions by op, and one key record per author.
ACTIONS = ["SetVoxel", "ClaimParcel", "PublishBlueprint", "RegisterRelay", "GrantAccess", "RevokeKey"]
ACTION_SQL = "(case event_id % 6 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ACTIONS)) + " end)"
KEYS = """(select s_suppkey peer, case s_nationkey % 6 when 0 then 'User' when 1 then 'Guest' when 2 then 'Relay' when 3 then 'Admin' when 4 then 'Server' else 'Trial' end key_type,
   s_acctbal*10e0 expires_at, s_suppkey % 11 = 0 revoked, s_suppkey % 13 <> 0 self_sig_ok from supplier)"""
OPS = f"(select event_id op_id, user_id author, {ACTION_SQL} as action, event_id % 17 <> 0 sig_ok from events)"


def permission_results(t):
    ops = t.sql(f"select * from {OPS} o")
    keys = t.sql(f"select * from {KEYS} k")
    return ol.key_permissions(ops, keys, F.lit(9000.0))


def _allow_sql(tier):
    arms = " ".join(
        f"when cls='{name}' then " + ("true" if types is None else f"{tier} in ({', '.join(repr(x) for x in types)})") for name, types in ol.ACTION_CLASS.items())
    return f"(case {arms} end)"


RESULT_SQL = f"""(select op_id, author, action, sig_ok, case when not sig_ok or not coalesce(self_sig_ok,true) then 'InvalidSignature' when coalesce(revoked,false) then 'Revoked'
   when coalesce(expires_at<9000,false) then 'Expired' when not {_allow_sql("tier")} then 'KeyTypeNotAllowed' else 'Allowed' end as result
   from (select o.*, k.expires_at, k.revoked, k.self_sig_ok, coalesce(k.key_type,'Guest') tier, {case_sql('action', ol.CLASS_OF_ACTION)} cls from {OPS} o left join {KEYS} k on k.peer=o.author) q)"""


@query("key_permissions", f"select op_id, author, action, sig_ok, result from {RESULT_SQL} r")
def key_permissions(t):
    return permission_results(t)


@query("op_stats", f"select author, count(*) received, count(*) filter (result='Allowed') applied, count(*) filter (result<>'Allowed') rejected from {RESULT_SQL} r group by author")
def op_stats(t):
    return ol.op_stats(permission_results(t), ["author"])


@query("offender_block", f"select author, count(*) denied from {RESULT_SQL} r where result<>'Allowed' group by author having count(*)>=5")
def offender_block(t):
    return ol.offender_block(permission_results(t))


# Parcels: boxes from suppliers on a plane of voxels; ops on the same plane.
PARCELS = """(select s_suppkey parcel_id, s_suppkey seq, s_suppkey % 40 as owner, (s_suppkey % 25)*37 x0, (s_suppkey % 25)*37+20+s_suppkey % 30 x1, 0 y0, 60+s_suppkey % 50 y1,
   cast(floor(s_suppkey/25e0) as bigint)*41 z0, cast(floor(s_suppkey/25e0) as bigint)*41+25+s_suppkey % 23 z1 from supplier)"""
PARCEL_OPS = "(select event_id op_id, user_id author, (event_id*7) % 950 vx, event_id % 90 vy, (event_id*13) % 200 vz from events)"
GRANTS = "(select s_suppkey parcel_id, (s_suppkey*3) % 150 grantee from supplier)"


@query("parcel_lookup", f"""select o.op_id, p.parcel_id, p.owner is null or p.owner=o.author or exists (select 1 from {GRANTS} g where g.parcel_id=p.parcel_id and g.grantee=o.author) allowed
   from {PARCEL_OPS} o left join (select o.op_id, min(p.parcel_id) parcel_id from {PARCEL_OPS} o join {PARCELS} p on vx between x0 and x1 and vy between y0 and y1 and vz between z0 and z1 group by o.op_id) h on h.op_id=o.op_id
   left join {PARCELS} p on p.parcel_id=h.parcel_id""")
def parcel_lookup(t):
    out = ol.parcel_lookup(t.sql(f"select * from {PARCEL_OPS} o"), t.sql(f"select * from {PARCELS} p"), t.sql(f"select * from {GRANTS} g"))
    return out.select("op_id", "parcel_id", "allowed")


PAIRS = f"(select b.seq, a.seq earlier from {PARCELS} a join {PARCELS} b on a.seq<b.seq and a.x0<=b.x1 and a.x1>=b.x0 and a.y0<=b.y1 and a.y1>=b.y0 and a.z0<=b.z1 and a.z1>=b.z0)"


@query("parcel_conflicts", f"select seq, earlier from {PAIRS} p")
def parcel_conflicts(t):
    return ol.parcel_conflicts(t.sql(f"select * from {PARCELS} p"))


@query("accept_claims")
def accept_claims(t):
    return ol.accept_claims(t.sql(f"select * from {PARCELS} p")).select("seq", "owner")


# A clock per op: what the author has seen of two others.
def clocked(t):
    own = F.create_map(F.col("author").cast("string"), F.col("op_id") + 1)
    seen = F.create_map(F.lit("s1"), F.col("op_id") % 7, F.lit("s2"), F.col("author") % 5)
    return t.op_log.withColumn("clock", F.map_concat(own, seen))


@query("clock_merge_agg", """select vx, peer, max(n) n from (select vx, cast(author as varchar) peer, op_id+1 n from op_log union all select vx, 's1', op_id % 7 from op_log union all select vx, 's2', author % 5 from op_log) q group by vx, peer""")
def clock_merge_agg(t):
    return ol.clock_merge_agg(clocked(t), ["vx"])


@query("causality_violations", """with c as (select op_id, author, lamport, vx, vy, vz, op_id % 11 = 0 sees from op_log), o as (select *, case when op_id % 11=0 then op_id+3000 end seen from c)
   select distinct o.vx, o.vy, o.vz, o.op_id from o join op_log p on p.vx=o.vx and p.vy=o.vy and p.vz=o.vz and p.author=o.author+10 and p.op_id<=o.seen and o.lamport<=p.lamport where o.seen is not null""")
def causality_violations(t):
    own = F.create_map(F.col("author").cast("string"), F.col("op_id"))
    other = F.create_map((F.col("author") + 10).cast("string"), F.col("op_id") + 3000)
    ops = t.op_log.withColumn("clock", F.when(F.col("op_id") % 11 == 0, F.map_concat(own, other)).otherwise(own))
    return ol.causality_violations(ops)


@query("lww_register_causal", """with o as (select *, case when op_id % 11=0 then op_id+3000 end seen from op_log), free as (select * from op_log p where not exists (select 1 from o where o.vx=p.vx and o.vy=p.vy and o.vz=p.vz and o.author=p.author-10 and o.seen>=p.op_id)
     and not exists (select 1 from op_log s where s.vx=p.vx and s.vy=p.vy and s.vz=p.vz and s.author=p.author and s.op_id>p.op_id))
   select vx, vy, vz, op_id from free qualify row_number() over (partition by vx, vy, vz order by lamport desc, author desc, op_id desc)=1""")
def lww_register_causal(t):
    own = F.create_map(F.col("author").cast("string"), F.col("op_id"))
    other = F.create_map((F.col("author") + 10).cast("string"), F.col("op_id") + 3000)
    ops = t.op_log.withColumn("clock", F.when(F.col("op_id") % 11 == 0, F.map_concat(own, other)).otherwise(own))
    return ol.lww_register_causal(ops).select("vx", "vy", "vz", "op_id")


@query("lamport_tick", """with recursive o as (select user_id, event_id, (event_id*31) % 97 rec, row_number() over (partition by user_id order by event_id) k from events),
   run as (select user_id, event_id, k, greatest(0,rec)+1 clock from o where k=1 union all select o.user_id, o.event_id, o.k, greatest(run.clock,o.rec)+1 from run join o on o.user_id=run.user_id and o.k=run.k+1) select user_id, event_id, clock from run""")
def lamport_tick(t):
    ev = t.events.select("user_id", "event_id", (F.col("event_id") * 31 % 97).alias("rec"))
    return ol.lamport_tick(ev, ["user_id"], "event_id", "rec").drop("rec")


@query("manifest_diff", "select m.o_orderkey chunk, m.o_custkey updated from orders m left join (select o_orderkey, o_custkey % 700 theirs from orders where o_orderkey % 3=0) p on p.o_orderkey=m.o_orderkey where coalesce(theirs,0)<m.o_custkey")
def manifest_diff(t):
    mine = t.orders.select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("updated"))
    peer = mine.where(F.col("chunk") % 3 == 0).withColumn("updated", F.col("updated") % 700)
    return ol.manifest_diff(mine, peer)


@query("resume_missing", "select o_orderkey chunk from orders where o_orderkey % 4 <> 1")
def resume_missing(t):
    from ..sources.sinks import resume_missing

    chunks = t.orders.select(F.col("o_orderkey").alias("chunk"))
    done = chunks.where(F.col("chunk") % 4 == 1).withColumn("pass", F.lit("roads"))
    return resume_missing(chunks, done, "roads", ["chunk"])


@query("read_op_log", "select op_id, author from op_log where op_id % 4 <> 0")
def read_op_log(t):
    from ..sources.readers import unseen_ops

    known = t.op_log.where(F.col("op_id") % 4 == 0)
    return unseen_ops(t.op_log, known).select("op_id", "author")


@query("fill_region", """select o_orderkey op_id, x vx, z vz, cast(5 as bigint) y0, 5+o_orderkey % 300 y1 from orders, lateral (select unnest(range(o_orderkey % 50, o_orderkey % 50 + o_orderkey % 4 + 1)) x) a,
   lateral (select unnest(range(o_custkey % 50, o_custkey % 50 + o_custkey % 3 + 1)) z) b""")
def fill_region(t):
    def v(dx, y, dz):
        return F.struct((F.col("o_orderkey") % 50 + dx).alias("x"), y.cast("bigint").alias("y"), (F.col("o_custkey") % 50 + dz).alias("z"))

    tall = F.col("o_orderkey") % 300
    ops = t.orders.select(F.col("o_orderkey").alias("op_id"), v(F.lit(0), F.lit(5), F.lit(0)).alias("box_min"), v(F.col("o_orderkey") % 4, tall + 5, F.col("o_custkey") % 3).alias("box_max"))
    return ol.fill_region(ops).select("op_id", "vx", "vz", "y0", "y1")


@query("material_histogram", f"select material, count(*) n from {WIN} w where material <> 'AIR' group by material")
def material_histogram(t):
    from ..operators.aggregates import material_histogram

    runs = ol.lww_register(t.op_log).where(F.col("material") != "AIR").select("material", F.col("vy").alias("y0"), F.col("vy").alias("y1"))
    return material_histogram(runs)
