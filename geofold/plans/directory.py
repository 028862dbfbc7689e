"""Queries for directories and syncs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import big
from ..operators import directory as dr
from .catalog import query


@query("latest_key_record", "select peer, updated_at, seq, key_type, revoked from key_record qualify row_number() over (partition by peer order by updated_at desc, seq desc)=1")
def latest_key_record(t):
    return dr.latest_key_record(t.key_record)


LATEST = "(select * from key_record qualify row_number() over (partition by peer order by updated_at desc, seq desc)=1)"


@query("key_counts", f"select key_type, count(*) n from {LATEST} k where not revoked group by rollup(key_type)")
def key_counts(t):
    return dr.key_counts(dr.latest_key_record(t.key_record))


@query("key_expire", "select peer, seq from key_record where revoked or updated_at >= timestamp '1998-01-01'")
def key_expire(t):
    return dr.key_expire(t.key_record, F.lit("1998-01-01").cast("timestamp")).select("peer", "seq")


REVOCATIONS = "(select o_custkey target, (o_custkey*7+o_orderkey) % 1000 as by_peer, o_orderkey at_no, o_orderpriority reason from orders where o_orderkey % 5=0)"


@query("revoke_keys", f"""select k.peer, k.revoked or x.target is not null revoked, case when not k.revoked then x.by_peer end revoked_by, case when not k.revoked then x.reason end reason from {LATEST} k left join
   (select r.* from {REVOCATIONS} r left join {LATEST} w on w.peer=r.by_peer where r.by_peer=r.target or (w.key_type in ('Admin','Server','Genesis','Relay') and not w.revoked)
    qualify row_number() over (partition by target order by at_no, by_peer)=1) x on x.target=k.peer""")
def revoke_keys(t):
    rev = t.sql(f"select * from {REVOCATIONS} r").withColumnRenamed("by_peer", "by").withColumnRenamed("at_no", "at")
    out = dr.revoke_keys(dr.latest_key_record(t.key_record), rev)
    return out.select("peer", "revoked", "revoked_by", "reason")


@query("trust_chain", """with recursive k as (select c_custkey peer, case when c_custkey % 10=0 then null else c_custkey-1 end issued_by, c_custkey % 17<>0 ok from customer),
   walk as (select peer, issued_by nxt, 0 hops, true ok, peer root from k union all select w.peer, k2.issued_by, w.hops+1, w.ok and k1.ok, w.nxt from walk w join k k1 on k1.peer=w.root join k k2 on k2.peer=w.nxt where w.nxt is not null)
   select peer, cast(hops as bigint) hops, ok, root from walk where nxt is null""")
def trust_chain(t):
    keys = t.customer.select(F.col("c_custkey").alias("peer"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey") - 1).alias("issued_by"), (F.col("c_custkey") % 17 != 0).alias("issuer_ok"))
    return dr.trust_chain(keys).select("peer", "hops", "ok", "root")


@query("node_directory", """select user_id peer, priority, seq, rtt_ms from (select user_id, event_id % 5 priority, event_id seq, value rtt_ms, ts from events where ts >= timestamp '2024-01-02') q
   qualify row_number() over (partition by user_id order by priority desc, seq desc)=1""")
def node_directory(t):
    nodes = t.events.select(F.col("user_id").alias("peer"), (F.col("event_id") % 5).alias("priority"), F.col("event_id").alias("seq"), F.col("value").alias("rtt_ms"), F.col("ts").alias("expires_at"))
    return dr.node_directory(nodes, F.lit("2024-01-02").cast("timestamp")).drop("expires_at")


@query("incremental_pull", "select peer, seq, updated_at from key_record where updated_at > timestamp '1997-03-01' or (updated_at = timestamp '1997-03-01' and seq > 400) order by updated_at, seq limit 1000")
def incremental_pull(t):
    page = dr.incremental_pull(t.key_record, F.lit("1997-03-01").cast("timestamp"), F.lit(400), 1000)
    return page.select("peer", "seq", "updated_at")


@query("section_top_n", "select section, id, rank from (select role section, conv_id*100+turn id, row_number() over (partition by role order by turn desc, conv_id*100+turn) rank from conversations) q where rank<=100")
def section_top_n(t):
    items = t.conversations.select(F.col("role").alias("section"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("turn").alias("created_at"))
    return dr.section_top_n(items, 100).select("section", "id", "rank")


OBJECTS = "(select o_orderkey object_id, cast(o_totalprice/100e0-2000e0 as double) x, cast(o_custkey*3 % 2000 - 1000 as double) z, o_orderpriority kind from orders)"


def objects(t):
    return t.sql(f"select * from {OBJECTS} o")


@query("objects_in_cell", f"select object_id from {OBJECTS} o where x>=-192 and x<-128 and z>=64 and z<128")
def objects_in_cell(t):
    return dr.objects_in_cell(objects(t), -3, 1).select("object_id")


@query("objects_per_cell", f"select cell_x, cell_z, n from (select cast(floor(x/64e0) as bigint) cell_x, cast(floor(z/64e0) as bigint) cell_z, count(*) n from {OBJECTS} o group by grouping sets ((cell_x, cell_z), ())) q")
def objects_per_cell(t):
    return dr.objects_per_cell(objects(t))


@query("object_registry", "select object_id, seq, event from (select user_id object_id, event_id seq, case when event_type='error' then 'delete' else 'put' end as event from events) q qualify row_number() over (partition by object_id order by seq desc)=1 and event<>'delete'")
def object_registry(t):
    ev = t.events.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("event"))
    return dr.object_registry(ev)


@query("override_upsert", "select user_id target_id, event_id arrival_seq, value scale from events qualify row_number() over (partition by user_id order by event_id desc)=1")
def override_upsert(t):
    return dr.override_upsert(t.events.select(F.col("user_id").alias("target_id"), F.col("event_id").alias("arrival_seq"), F.col("value").alias("scale")))


CELL_OVERRIDES = "(select s_suppkey override_id, cast(s_nationkey-12 as bigint) cell_x, cast(s_suppkey % 21-10 as bigint) cell_z from supplier)"


@query("object_details", f"select object_id, override_id from {OBJECTS} o left join {CELL_OVERRIDES} v on v.cell_x=floor(x/64e0) and v.cell_z=floor(z/64e0)")
def object_details(t):
    return dr.object_details(objects(t), t.sql(f"select * from {CELL_OVERRIDES} v")).select("object_id", "override_id")


@query("request_queue", "select o_orderkey id, o_orderdate created_at from orders where o_orderstatus='P'")
def request_queue(t):
    req = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return dr.request_queue(req, "P").select("id", "created_at")


@query("review_requests", """select o_orderkey id, case when o_orderstatus='P' and v.verdict is not null then v.verdict when o_orderstatus='P' then 'pending' else 'closed' end status from orders
   left join (select l_orderkey, case when l_returnflag='R' then 'denied' else 'approved' end verdict from lineitem where l_returnflag<>'N' qualify row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_extendedprice)=1) v on v.l_orderkey=o_orderkey""")
def review_requests(t):
    req = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("closed").alias("status"))
    verdict = F.when(F.col("l_returnflag") == "R", "denied").when(F.col("l_returnflag") == "A", "approved").otherwise("noted")
    rev = t.lineitem.select(F.col("l_orderkey").alias("id"), verdict.alias("verdict"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("review_seq"))
    return dr.review_requests(req, rev)


@query("session_latest", "select peer, ts, lamport, ts < timestamp '2024-01-20' - interval 10 day stale from (select user_id peer, ts, event_id lamport from events) q qualify row_number() over (partition by peer order by ts desc, lamport desc)=1")
def session_latest(t):
    rec = t.events.select(F.col("user_id").alias("peer"), "ts", F.col("event_id").alias("lamport"))
    return dr.session_latest(rec, F.lit("2024-01-20").cast("timestamp"), 10)


@query("union_sources", "select o_orderkey k, case when o_orderkey % 3=0 then 'a' else 'b' end src from orders where o_orderkey % 3=0 or o_orderkey % 2=0")
def union_sources(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"))
    a = o.where(F.col("k") % 3 == 0).withColumn("src", F.lit("a"))
    b = o.where(F.col("k") % 2 == 0).withColumn("src", F.lit("b"))
    return dr.union_sources([a, b], ["k"])


HAVE = "(select distinct user_id peer, cast(event_id % 30 as varchar) topic from events where event_type='view')"
WANT = "(select distinct user_id peer, cast(event_id % 30 as varchar) topic from events where event_type='click')"


@query("topic_diff", f"select *, 'add' as change from ({WANT} except {HAVE}) a union all select *, 'remove' from ({HAVE} except {WANT}) b".replace("except (select", "except select").replace("(select distinct user_id peer, cast(event_id % 30 as varchar) topic from events where event_type='click') except", "select distinct user_id peer, cast(event_id % 30 as varchar) topic from events where event_type='click' except").replace("(select distinct user_id peer, cast(event_id % 30 as varchar) topic from events where event_type='view') except", "select distinct user_id peer, cast(event_id % 30 as varchar) topic from events where event_type='view' except").replace("='view'))", "='view')").replace("='click'))", "='click')"))
def topic_diff(t):
    def topics(kind):
        return t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("peer"), (F.col("event_id") % 30).cast("string").alias("topic"))

    return dr.topic_diff(topics("view"), topics("click"))


SRC = "(select lang site, doc_id as key, case when doc_id % 19=0 then null else text end payload from documents where doc_id % 3<>0)"
DST = "(select lang site, doc_id as key, case when doc_id % 5=0 then text||'x' else text end payload from documents where doc_id % 4<>0)"
MERGED = f"(select s.site, s.key, case when s.payload is null then 'unreadable' when d.key is null then 'added' when sha256(s.payload)=sha256(d.payload) then 'identical' else 'updated' end status from {SRC} s left join {DST} d on d.site=s.site and d.key=s.key)"


@query("pack_merge", f"""select site, count(*) filter (status='added') added, count(*) filter (status='updated') updated, count(*) filter (status='identical') identical, count(*) filter (status='unreadable') unreadable from {MERGED} m group by rollup(site)""")
def pack_merge(t):
    merged = dr.pack_merge(t.sql(f"select * from {SRC} s"), t.sql(f"select * from {DST} d"))
    return dr.pack_merge_report(merged)


@query("pack_merge_apply", f"select coalesce(s.site,d.site) site, coalesce(s.key,d.key) as key, sha256(case when s.payload is not null then s.payload else d.payload end) digest from (select * from {SRC} s0 where payload is not null) s full join {DST} d on d.site=s.site and d.key=s.key")
def pack_merge_apply(t):
    out = dr.pack_merge_apply(t.sql(f"select * from {SRC} s"), t.sql(f"select * from {DST} d"))
    return out.select("site", "key", F.sha2("payload", 256).alias("digest"))


@query("apply_overrides", """with o as (select s_suppkey object_id, s_name kind, s_acctbal x, s_acctbal/2e0 y, s_acctbal/3e0 z, 0e0 rotation_y, 1e0 scale from supplier),
   v as (select user_id target_id, case event_type when 'view' then 'move' when 'click' then 'replace' when 'purchase' then 'scale' when 'error' then case when event_id % 5=0 then 'remove' else 'move' end else 'noop' end as action, event_id ts, event_id % 9<>0 sig_ok, value from events),
   m as (select target_id, bool_or(action='remove') gone, arg_max(value, ts) filter (action='move') mv, arg_max(ts, ts) filter (action='move') mt, arg_max('t'||cast(ts as varchar), ts) filter (action='replace') nt, arg_max(value/10e0, ts) filter (action='scale') sc from v where sig_ok group by target_id)
   select object_id, coalesce(nt,kind) kind, coalesce(mv,x) x, coalesce(mv+1,y) y, coalesce(cast(mt as double),rotation_y) rotation_y, coalesce(sc,scale) scale from o left join m on m.target_id=o.object_id where not coalesce(gone,false)""")
def apply_overrides(t):
    from ..operators.inference import apply_overrides

    obj = t.supplier.select(F.col("s_suppkey").alias("object_id"), F.col("s_name").alias("kind"), F.col("s_acctbal").alias("x"), (F.col("s_acctbal") / 2).alias("y"), (F.col("s_acctbal") / 3).alias("z"), F.lit(0.0).alias("rotation_y"), F.lit(1.0).alias("scale"))
    e = F.col("event_type")
    action = F.when(e == "view", "move").when(e == "click", "replace").when(e == "purchase", "scale").when((e == "error") & (F.col("event_id") % 5 == 0), "remove").when(e == "error", "move").otherwise("noop")
    ov = t.events.select(F.col("user_id").alias("target_id"), action.alias("action"), F.col("event_id").alias("ts"), (F.col("event_id") % 9 != 0).alias("sig_ok"), F.col("value").alias("x"), (F.col("value") + 1).alias("y"), (F.col("value") + 2).alias("z"),
                         F.col("event_id").cast("double").alias("rotation_y"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("new_type"), (F.col("value") / 10).alias("scale"))
    return apply_overrides(obj, ov).select("object_id", "kind", "x", "y", "rotation_y", "scale")


@query("tile_counts", "select lang family, count(*) n from documents group by lang")
def tile_counts(t):
    return dr.by_count(t.documents.select(F.col("lang").alias("family")), "family")


@query("world_counts", "select 'ops' kind, count(*) n from events union all select 'parcels', count(*) from supplier union all select 'players', count(distinct user_id) from events")
def world_counts(t):
    rows = (
        t.events.select(F.lit("ops").alias("kind"), F.col("event_id").alias("id"))
        .unionByName(t.supplier.select(F.lit("parcels").alias("kind"), F.col("s_suppkey").alias("id")))
        .unionByName(t.events.select(F.lit("players").alias("kind"), F.col("user_id").alias("id")).distinct())
    )
    return dr.by_count(rows, "kind")
