"""Key, content and object directories, and their syncs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import OBJECT_CELL_M, big, col
from .skew import salted_join

# Address routes and the tier each needs.
ROUTES = {
    "": "Root",
    "signup": "Signup",
    "forums": "Forums",
    "wiki": "Wiki",
    "marketplace": "Marketplace",
    "world/construct": "WorldConstruct",
    "world/objects": "WorldObjects",
    "settings": "Settings",
    "settings/identity": "SettingsIdentity",
    "settings/property": "SettingsProperty",
    "settings/inventory": "SettingsInventory",
    "admin/keys": "AdminKeys",
    "admin/regions": "AdminRegions",
    "admin/moderation": "AdminModeration",
    "admin/worldconfig": "AdminWorldConfig",
}
ROUTE_PATTERNS = {
    "^forums/thread/[^/]*$": "ForumThread",
    "^wiki/[^/]*$": "WikiPage",
    "^user/[^/]*$": "UserProfile",
    "^world/chunk/[^/]*/[^/]*$": "WorldChunk",
    "^world/object/[^/]*$": "WorldObject",
}
GUEST_ROUTES = ["UserProfile", "Settings", "SettingsIdentity", "SettingsProperty", "SettingsInventory"]
ADMIN_ROUTES = ["AdminKeys", "AdminRegions", "AdminModeration", "AdminWorldConfig"]
GUEST_TIERS = ["Guest", "User", "Business", "Admin", "Relay", "Server", "Genesis"]
ADMIN_TIERS = ["Admin", "Server", "Genesis"]
REVOKERS = ["Admin", "Server", "Genesis", "Relay"]


def content_id(section, title, body, author, created_at) -> Column:
    """SHA-256 hex of the fields joined by a zero byte."""
    parts = [section, title, body, author, col(created_at).cast("string")]
    return F.sha2(F.concat_ws("\0", *[col(p) for p in parts]), 256)


def address_route(address) -> Column:
    path = F.regexp_replace(F.regexp_replace(col(address), "^worldnet://", ""), "^/+|/+$", "")
    out = None
    for text, name in ROUTES.items():
        out = F.when(path == text, F.lit(name)) if out is None else out.when(path == text, F.lit(name))
    for pattern, name in ROUTE_PATTERNS.items():
        out = out.when(path.rlike(pattern), F.lit(name))
    return out.otherwise("Custom")


def address_required(route) -> Column:
    return F.when(col(route).isin(*GUEST_ROUTES), "Guest").when(col(route).isin(*ADMIN_ROUTES), "Admin")


def address_access(route, tier) -> Column:
    need = address_required(route)
    ok = F.when(need.isNull(), F.lit(True)).when(need == "Guest", col(tier).isin(*GUEST_TIERS))
    return F.coalesce(ok.otherwise(col(tier).isin(*ADMIN_TIERS)), F.lit(False))


def key_expired(expires_at, as_of) -> Column:
    return F.coalesce(col(expires_at) < col(as_of), F.lit(False))


def effective_key_type(key_type, expires_at, revoked, as_of) -> Column:
    return F.when(col(revoked) | key_expired(expires_at, as_of), "Guest").otherwise(col(key_type))


def latest_key_record(records: DataFrame, key: str = "peer", order: Sequence[str] = ("updated_at", "seq")) -> DataFrame:
    """Newest record per peer; the tie-break columns follow the time."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def key_counts(keys: DataFrame) -> DataFrame:
    """Live keys by type, with the total in the row without a type."""
    return keys.where(~F.col("revoked")).rollup("key_type").agg(F.count(F.lit(1)).alias("n"))


def key_expire(records: DataFrame, cutoff) -> DataFrame:
    """Drop records older than the cutoff, but keep tombstones."""
    return records.where(F.col("revoked") | (F.col("updated_at") >= cutoff))


def revoke_keys(keys: DataFrame, revocations: DataFrame) -> DataFrame:
    """Apply the earliest permitted revocation of each key; known, unrevoked targets only.

    ``revocations``: target, by, at, reason.  A key may be revoked by itself or by an authority.
    """
    who = keys.select(F.col("peer").alias("by"), F.col("key_type").alias("_tier"), F.col("revoked").alias("_by_revoked"))
    valid = revocations.join(who, "by", "left").where(
        (F.col("by") == F.col("target")) | (F.col("_tier").isin(*REVOKERS) & ~F.col("_by_revoked"))
    )
    first = valid.groupBy(F.col("target").alias("peer")).agg(
        F.min_by(F.struct("by", "at", "reason"), F.struct("at", "by")).alias("_x")
    )
    out = keys.join(first, "peer", "left")
    now = ~F.col("revoked") & F.col("_x").isNotNull()
    return (
        out.withColumn("revoked_by", F.when(now, F.col("_x.by")))
        .withColumn("revoked_at", F.when(now, F.col("_x.at")))
        .withColumn("reason", F.when(now, F.col("_x.reason")))
        .withColumn("revoked", F.col("revoked") | now)
        .drop("_x")
    )


def trust_chain(keys: DataFrame) -> DataFrame:
    """Hops from each key to the end of its ``issued_by`` chain, that end, and whether every hop is counter-signed.

    ``keys``: peer, issued_by (null at a root), issuer_ok.  Walks with pointer doubling until no pointer is left, so
    chains have any length in log rounds.  Keys still walking after more hops than there are keys run into a cycle:
    ``cycle`` is true, ``ok`` false, and hops and root are null.
    """
    from ..session import cut_lineage

    state = cut_lineage(keys.select(
        "peer", F.col("issued_by").alias("at"), F.when(F.col("issued_by").isNull(), 0).otherwise(1).cast("bigint").alias("hops"),
        F.coalesce(F.col("issued_by").isNull() | F.col("issuer_ok"), F.lit(False)).alias("ok"),
        F.coalesce("issued_by", "peer").alias("root"),
    ))
    hop, count = 1, state.count()
    while hop <= 2 * count and state.where(F.col("at").isNotNull()).limit(1).count():
        nxt = state.select(F.col("peer").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_h"), F.col("ok").alias("_ok"), F.col("root").alias("_root"))
        state = state.join(nxt, "at", "left").select(
            "peer", F.col("_at").alias("at"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"),
            (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), F.coalesce("_root", "root").alias("root"),
        )
        state, hop = cut_lineage(state), hop * 2
    ends = F.col("at").isNull()
    return state.select(
        "peer", F.when(ends, F.col("hops")).alias("hops"), (F.col("ok") & ends).alias("ok"), F.when(ends, F.col("root")).alias("root"), (~ends).alias("cycle"),
    )


def node_directory(nodes: DataFrame, as_of) -> DataFrame:
    """Best entry per peer: highest priority, not expired, ordered by round-trip time then priority."""
    live = nodes.where(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))
    rest = [c for c in nodes.columns if c != "peer"]
    best = live.groupBy("peer").agg(F.max_by(F.struct(*rest), F.struct("priority", "seq")).alias("_n")).select("peer", "_n.*")
    return best.orderBy(F.asc_nulls_last("rtt_ms"), F.desc("priority"), "peer")


def incremental_pull(rows: DataFrame, since, since_id, limit: int, time: str = "updated_at", ident: str = "seq") -> DataFrame:
    """The next page after the cursor ``(time, id)``, ascending; rows sharing a time are never skipped."""
    later = (F.col(time) > since) | ((F.col(time) == since) & (F.col(ident) > since_id))
    return rows.where(later).orderBy(time, ident).limit(limit)


def high_water(page: DataFrame, time: str = "updated_at", ident: str = "seq") -> DataFrame:
    """Cursor after a page."""
    return page.agg(F.max(F.struct(time, ident)).alias("_c")).select("_c.*")


def section_top_n(items: DataFrame, n: int, section: str = "section", *order) -> DataFrame:
    """Newest ``n`` per section.  Spark applies the rank limit before the shuffle too, so hot sections stay small."""
    w = Window.partitionBy(section).orderBy(*(order or (F.desc("created_at"), F.col("id"))))
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("rank", big(F.col("rank")))


def object_cell(x, z) -> Column:
    return F.struct(
        big(F.floor(col(x) / OBJECT_CELL_M)).alias("cell_x"), big(F.floor(col(z) / OBJECT_CELL_M)).alias("cell_z")
    )


def objects_in_cell(objects: DataFrame, cell_x: int, cell_z: int) -> DataFrame:
    s = OBJECT_CELL_M
    return objects.where(
        (F.col("x") >= cell_x * s) & (F.col("x") < (cell_x + 1) * s) & (F.col("z") >= cell_z * s) & (F.col("z") < (cell_z + 1) * s)
    )


def objects_per_cell(objects: DataFrame) -> DataFrame:
    """Objects per 64 m cell, and the total in the row without a cell."""
    keyed = objects.select(object_cell("x", "z").alias("cell"))
    counts = keyed.rollup("cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("cell.cell_x").alias("cell_x"), F.col("cell.cell_z").alias("cell_z"), "n")


def object_registry(events: DataFrame) -> DataFrame:
    """Objects after inserts, replacements and deletes: the latest event per id, unless it deletes."""
    rest = [c for c in events.columns if c != "object_id"]
    last = events.groupBy("object_id").agg(F.max_by(F.struct(*rest), "seq").alias("_e")).select("object_id", "_e.*")
    return last.where(F.col("event") != "delete")


def override_upsert(overrides: DataFrame, by: str = "arrival_seq") -> DataFrame:
    """One override per target: the last to arrive, or the latest by another column."""
    rest = [c for c in overrides.columns if c != "target_id"]
    return overrides.groupBy("target_id").agg(F.max_by(F.struct(*rest), by).alias("_o")).select("target_id", "_o.*")


def object_details(objects: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each object with the overrides of its cell, one row per pair; objects without any keep one row."""
    placed = objects.select("*", object_cell("x", "z").alias("_c")).select("*", "_c.*").drop("_c")
    return salted_join(placed, overrides, ["cell_x", "cell_z"], ["object_id"], "left")


def request_queue(requests: DataFrame, status: str) -> DataFrame:
    """Requests with a status, newest first."""
    return requests.where(F.col("status") == status).orderBy(F.desc("created_at"), "id")


def review_requests(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """Apply the first approve or deny to each pending request; later reviews change nothing."""
    first = reviews.where(F.col("verdict").isin("approved", "denied")).groupBy("id").agg(
        F.min_by("verdict", "review_seq").alias("_v")
    )
    out = requests.join(first, "id", "left")
    return out.withColumn(
        "status", F.when((F.col("status") == "pending") & F.col("_v").isNotNull(), F.col("_v")).otherwise(F.col("status"))
    ).drop("_v")


def session_latest(records: DataFrame, as_of, stale_days: int) -> DataFrame:
    """Latest logout record per player, and whether it is older than ``stale_days``."""
    rest = [c for c in records.columns if c != "peer"]
    last = records.groupBy("peer").agg(F.max_by(F.struct(*rest), F.struct("ts", "lamport")).alias("_r")).select("peer", "_r.*")
    return last.withColumn("stale", F.col("ts") < as_of - F.expr(f"interval {stale_days} days"))


def union_sources(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources, the earlier source winning for equal keys."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("_src", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    rest = [c for c in sources[0].columns if c not in keys]
    best = tagged.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_src").alias("_b"))
    return best.select(*keys, "_b.*")


def topic_diff(have: DataFrame, want: DataFrame) -> DataFrame:
    """Topics to add and to remove per peer."""
    keys = ["peer", "topic"]
    have, want = have.select(*keys).distinct(), want.select(*keys).distinct()
    add = want.join(have, keys, "left_anti").withColumn("change", F.lit("add"))
    return add.unionByName(have.join(want, keys, "left_anti").withColumn("change", F.lit("remove")))


def pack_merge(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Status of each source row against the destination: added, updated, identical or unreadable.

    Both: site, key, payload; a null payload is unreadable.
    """
    d = dest.select("site", "key", F.sha2("payload", 256).alias("_theirs"), F.lit(True).alias("_has"))
    joined = source.join(d, ["site", "key"], "left")
    status = (
        F.when(F.col("payload").isNull(), "unreadable")
        .when(F.col("_has").isNull(), "added")
        .when(F.col("_theirs").eqNullSafe(F.sha2("payload", 256)), "identical")
        .otherwise("updated")
    )
    return joined.withColumn("status", status).drop("_theirs", "_has")


def pack_merge_report(merged: DataFrame) -> DataFrame:
    """Counts by status per site; the total in the row without a site."""
    def n(s):
        return F.count_if(F.col("status") == s).alias(s)

    return merged.rollup("site").agg(n("added"), n("updated"), n("identical"), n("unreadable"))


def pack_merge_apply(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Destination after the merge: readable source rows replace or join it."""
    return union_sources([source.where(F.col("payload").isNotNull()), dest], ["site", "key"])


def region_tile_extract(tiles: DataFrame, lat_min, lat_max, lon_min, lon_max, margin: float = 0.02, tile_deg: float = 0.01) -> DataFrame:
    """Mark tiles ``(tile_s, tile_w)`` that touch a box with a margin."""
    s, w = F.col("tile_s") * tile_deg, F.col("tile_w") * tile_deg
    hit = (
        (s + tile_deg >= lat_min - margin) & (s <= lat_max + margin) & (w + tile_deg >= lon_min - margin) & (w <= lon_max + margin)
    )
    return tiles.withColumn("inside", hit)


def tile_inventory_diff(required: DataFrame, held: DataFrame) -> DataFrame:
    return required.join(held, ["tile_s", "tile_w"], "left_anti")


def by_count(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
