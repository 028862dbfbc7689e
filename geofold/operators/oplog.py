"""Edit log: merge, replay order, permissions, parcels and catch-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clocks import clock_compare
from ..functions.geo import big, col
from .chunks import CHUNK_X, CHUNK_Z, affected_chunks
from .skew import dense_position, salted_join
from .spatial_join import box_pairs

VOXEL = ["vx", "vy", "vz"]

# Key types allowed per action class; None means every type.
KEY_TYPES = ["Guest", "User", "Business", "Admin", "Relay", "Server", "Genesis", "Trial"]
_OWNERS = ["User", "Business", "Server", "Genesis"]
_BUILDERS = ["User", "Business", "Admin", "Server", "Genesis"]
_NOT_GUEST = ["User", "Business", "Admin", "Server", "Genesis", "Trial"]
ACTION_CLASS = {
    "Explore": None,
    "BuildInFreeZone": ["Guest", "User", "Business", "Admin", "Server", "Genesis", "Trial"],
    "BuildInOwnedParcel": _BUILDERS,
    "ClaimParcel": _OWNERS,
    "AbandonParcel": _OWNERS,
    "TransferOwnership": _OWNERS,
    "GrantAccess": _BUILDERS,
    "RevokeAccess": _BUILDERS,
    "PublishContent": _NOT_GUEST,
    "ImportAsset": _NOT_GUEST,
    "CreateListing": _OWNERS,
    "SignContract": _OWNERS,
    "DeployScript": _BUILDERS,
    "Vote": ["User", "Business", "Admin", "Server"],
    "CreateProposal": _BUILDERS,
    "ModerateUser": ["Admin", "Server", "Genesis"],
    "PublishKeyRecord": None,
    "RevokeKey": None,
    "ManageRelay": ["Relay", "Server", "Genesis"],
    "IssueKey": ["Server", "Genesis"],
}
# Class of each action.
CLASS_OF_ACTION = {
    "SetVoxel": "BuildInFreeZone",
    "RemoveVoxel": "BuildInFreeZone",
    "FillRegion": "BuildInFreeZone",
    "PlaceObject": "BuildInFreeZone",
    "RemoveObject": "BuildInFreeZone",
    "MoveObject": "BuildInFreeZone",
    "ConfigureObject": "BuildInFreeZone",
    "ClaimParcel": "ClaimParcel",
    "AbandonParcel": "AbandonParcel",
    "TransferOwnership": "TransferOwnership",
    "GrantAccess": "GrantAccess",
    "RevokeAccess": "RevokeAccess",
    "CreateListing": "CreateListing",
    "AcceptListing": "SignContract",
    "CancelListing": "TransferOwnership",
    "SignContract": "SignContract",
    "PublishBlueprint": "PublishContent",
    "ImportAsset": "ImportAsset",
    "PublishKeyRecord": "PublishKeyRecord",
    "RevokeKey": "RevokeKey",
    "RegisterRelay": "ManageRelay",
}


def op_id(signature) -> Column:
    """First 32 bytes (or hex digits) of the signature."""
    return F.substring(col(signature), 1, 32)


def dedup_signature(ops: DataFrame, ident: str = "op_id", *order) -> DataFrame:
    """One row per signature; the first by ``order`` when given."""
    if not order:
        return ops.dropDuplicates([ident])
    rest = [c for c in ops.columns if c != ident]
    best = ops.groupBy(ident).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_o"))
    return best.select(ident, "_o.*")


def lww_register(ops: DataFrame, keys: Sequence[str] = VOXEL, value: Sequence[str] = ("material",)) -> DataFrame:
    """Winner per voxel: highest (lamport, author, op_id).

    Exact when a causally later op has a higher Lamport time, which ``causality_violations`` checks.  ``max_by``
    keeps one row per key and partition before the shuffle, so a hot voxel costs no more than any other.
    """
    body = F.struct("op_id", "author", "lamport", *value)
    best = ops.groupBy(*keys).agg(F.max_by(body, F.struct("lamport", "author", "op_id")).alias("_w"))
    return best.select(*keys, "_w.*")


def causality_violations(ops: DataFrame, keys: Sequence[str] = VOXEL) -> DataFrame:
    """Ops whose Lamport time contradicts their vector clock on the same voxel.

    For each author component, an op that has seen ``n`` of that author's ops must have a Lamport time above
    that of the author's n-th op.  It needs one window per author, not a comparison of all pairs.
    """
    own = ops.select(
        *keys, F.col("author").alias("peer"), F.element_at("clock", F.col("author").cast("string")).alias("n"),
        F.col("lamport").alias("own_lamport"), F.lit(True).alias("is_own"), F.lit(None).cast("bigint").alias("viewer"),
    )
    seen = ops.select(*keys, F.explode("clock").alias("peer", "n"), "lamport", "author", "op_id").where(
        F.col("peer") != F.col("author").cast("string")
    )
    seen = seen.select(*keys, "peer", "n", "lamport", "op_id")
    latest = own.groupBy(*keys, F.col("peer").cast("string").alias("peer"), "n").agg(F.max("own_lamport").alias("at"))
    w = Window.partitionBy(*keys, "peer").orderBy("n").rangeBetween(Window.unboundedPreceding, 0)
    marks = latest.select(*keys, "peer", "n", "at", F.lit(None).cast("bigint").alias("lamport"), F.lit(None).cast("bigint").alias("op_id"))
    both = marks.unionByName(seen.select(*keys, "peer", "n", F.lit(None).cast("bigint").alias("at"), "lamport", "op_id"))
    high = both.withColumn("_top", F.max("at").over(w))
    return high.where(F.col("op_id").isNotNull() & (F.col("lamport") <= F.col("_top"))).select(*keys, "op_id").distinct()


def lww_register_causal(ops: DataFrame, keys: Sequence[str] = VOXEL) -> DataFrame:
    """Register that drops causally dominated ops first, then takes ``max_by(lamport, author)``.

    For logs whose Lamport times do not respect causality.  An op is dominated on a voxel when another op's clock
    covers it; since clocks grow along an author's own ops, it is enough that some op of the voxel has seen the
    author's component at least as far, so one maximum per author and voxel replaces the comparison of pairs.
    """
    parts = ops.select(*keys, "op_id", "author", F.explode("clock").alias("peer", "n"))
    own = F.col("peer") == F.col("author").cast("string")
    reach = parts.groupBy(*keys, "peer").agg(
        F.max(F.when(~own, F.col("n"))).alias("by_others"), F.max(F.when(own, F.col("n"))).alias("by_self")
    )
    mine = ops.withColumn("peer", F.col("author").cast("string")).withColumn("_n", F.element_at("clock", F.col("peer")))
    tested = mine.join(reach, [*keys, "peer"])
    free = tested.where(
        (F.coalesce(F.col("by_others"), F.lit(-1)) < F.col("_n")) & (F.col("by_self") <= F.col("_n"))
    )
    return lww_register(free.drop("peer", "_n", "by_others", "by_self"), keys)


def replay_order(ops: DataFrame, chunk: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Position of each op in its chunk, oldest first by (lamport, author, op_id).

    With ``bucket`` (a column that grows with ``lamport``) a hot chunk is ranked in pieces: rows are numbered inside
    each (chunk, bucket) and shifted by the count of the buckets before.
    """
    bucket = F.floor(F.col("lamport") / 100000) if bucket is None else bucket
    return dense_position(ops, chunk, bucket, ["lamport", "author", "op_id"])


def ops_by_chunk(ops: DataFrame) -> DataFrame:
    """Fan each op out to every chunk it affects (``cx, cy, cz``)."""
    out = ops.withColumn("_c", F.explode(affected_chunks(*VOXEL)))
    return out.select("*", F.col("_c.x").alias("cx"), F.col("_c.y").alias("cy"), F.col("_c.z").alias("cz")).drop("_c")


def state_catch_up(ops: DataFrame, requests: DataFrame, page_size: int = 100) -> DataFrame:
    """Ops for requested chunks, each op once per request under its first matching chunk, in pages.

    ``requests``: request_id, seq, cx, cy, cz.  The chunks of an op touch each other, so a requested chunk knows which
    earlier ones of its request can share an op (26 at most), and an op that also lies in one of these is left to it.
    Hits are thus never gathered by request and op; only ids that the log repeats are.
    """
    chunk = ["cx", "cy", "cz"]
    ops = ops.withColumn("_in", affected_chunks(*VOXEL))
    repeats = ops.groupBy(F.col("op_id").alias("_op")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_op")
    again = ops["op_id"].eqNullSafe(repeats["_op"])
    wanted = _with_earlier(requests)
    found = []
    for part in (ops.join(repeats, again, "left_anti"), ops.join(repeats, again, "left_semi")):
        fanned = part.withColumn("_c", F.explode("_in")).select("*", *[F.col(f"_c.{x}").alias(c) for x, c in zip("xyz", chunk)]).drop("_c")
        hits = (salted_join(fanned, wanted, chunk, ["op_id"]) if not found else fanned.join(wanted, chunk)).where(~F.arrays_overlap("_in", "_earlier"))
        found.append(hits.select("request_id", "op_id", "seq", *chunk, "lamport", "author", "material"))
    once, more = found
    body = F.struct("seq", *chunk, "lamport", "author", "material")
    more = more.groupBy("request_id", "op_id").agg(F.min_by(body, F.struct("seq", *chunk)).alias("_h")).select("request_id", "op_id", "_h.*")
    ranked = replay_order(once.unionByName(more), ["request_id"])
    return ranked.withColumn("page", big(F.floor((F.col("pos") - 1) / page_size)))


def _with_earlier(requests: DataFrame) -> DataFrame:
    """Each requested chunk once, with ``_earlier``: the chunks beside it (x, y, z) that its request names before it."""
    chunk = ["cx", "cy", "cz"]
    rows = requests.groupBy("request_id", *[big(F.col(c)).alias(c) for c in chunk]).agg(F.min("seq").alias("seq"))
    near = rows.select(F.col("request_id").alias("_r"), F.struct("seq", *chunk).alias("_first"), *chunk)
    for c in chunk:
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    near = near.select("_r", "_first", *[F.col(c).alias(f"_{c}") for c in chunk])
    same = F.col("request_id").eqNullSafe(F.col("_r"))
    for c in chunk:
        same = same & (F.col(c) == F.col(f"_{c}"))
    both = rows.join(near, same & (F.col("_first") <= F.struct("seq", *chunk)))
    names = F.struct(*[F.col(f"_first.{c}").alias(x) for c, x in zip(chunk, "xyz")])
    # A chunk also meets itself, so each has a row; lists take no nulls.
    itself = F.col("_first") == F.struct("seq", *chunk)
    return both.groupBy("request_id", *chunk, "seq").agg(F.collect_list(F.when(~itself, names)).alias("_earlier"))


def fill_region(ops: DataFrame, chunk_x: int = CHUNK_X, chunk_z: int = CHUNK_Z) -> DataFrame:
    """Fill ops ``box_min, box_max`` as vertical runs ``vx, vz, y0, y1``, for boxes of any size.

    A box is first split by chunk and then by column inside its chunk; heights are never expanded.  Empty boxes give
    no run.
    """
    lo, hi = F.col("box_min"), F.col("box_max")
    out = ops.where((lo["x"] <= hi["x"]) & (lo["y"] <= hi["y"]) & (lo["z"] <= hi["z"]))
    for a, size in (("x", chunk_x), ("z", chunk_z)):
        out = out.withColumn(f"c{a}", F.explode(F.sequence(big(F.floor(lo[a] / size)), big(F.floor(hi[a] / size)))))
    for a, size in (("x", chunk_x), ("z", chunk_z)):
        c = F.col(f"c{a}") * size
        out = out.withColumn(f"v{a}", F.explode(F.sequence(F.greatest(lo[a], c), F.least(hi[a], c + size - 1))))
    return out.withColumn("y0", lo["y"]).withColumn("y1", hi["y"])


# ---------------------------------------------------------------------------------------------------------
# Permissions and parcels
# ---------------------------------------------------------------------------------------------------------
def class_allows(key_type, action_class) -> Column:
    """Whether a key type may do an action of a class, from the fixed table."""
    kt, ac = col(key_type), col(action_class)
    out = F.when(F.lit(False), F.lit(False))
    for name, types in ACTION_CLASS.items():
        out = out.when(ac == name, F.lit(True) if types is None else kt.isin(*types))
    return out.otherwise(F.lit(False))


def action_class(action) -> Column:
    from ..functions.rules import lookup

    return lookup(action, CLASS_OF_ACTION)


def key_permissions(ops: DataFrame, keys: DataFrame, as_of) -> DataFrame:
    """First failing check per op: signature, revoked, expired, class table; unknown authors count as Guest.

    ``ops``: op_id, author, action, sig_ok.  ``keys``: one row per peer with key_type, expires_at, revoked, self_sig_ok.
    """
    k = keys.select(
        F.col("peer").alias("author"), "key_type", "expires_at", "revoked", F.col("self_sig_ok").alias("_self_ok")
    )
    joined = salted_join(ops, k, ["author"], ["op_id"], "left")
    revoked = F.coalesce("revoked", F.lit(False))
    expired = F.coalesce(F.col("expires_at") < as_of, F.lit(False))
    tier = F.coalesce("key_type", F.lit("Guest"))
    result = (
        F.when(~F.col("sig_ok") | ~F.coalesce("_self_ok", F.lit(True)), "InvalidSignature")
        .when(revoked, "Revoked")
        .when(expired, "Expired")
        .when(~class_allows(tier, action_class("action")), "KeyTypeNotAllowed")
        .otherwise("Allowed")
    )
    return joined.withColumn("result", result).drop("key_type", "expires_at", "revoked", "_self_ok")


def parcel_lookup(ops: DataFrame, parcels: DataFrame, grants: DataFrame, cell: int = 64) -> DataFrame:
    """Owner of the parcel holding each op's voxel and whether the author may build there.

    ``parcels``: parcel_id, owner, x0..z1 (inclusive).  ``grants``: parcel_id, grantee.  Ops without a voxel, and
    voxels outside every parcel, are allowed.
    """

    def span(a):
        return F.sequence(big(F.floor(F.col(f"{a}0") / cell)), big(F.floor(F.col(f"{a}1") / cell)))

    keyed = parcels.withColumn("gx", F.explode(span("x"))).withColumn("gz", F.explode(span("z")))
    placed = ops.withColumn("gx", big(F.floor(F.col("vx") / cell))).withColumn("gz", big(F.floor(F.col("vz") / cell)))
    inside = salted_join(placed.select("op_id", "author", *VOXEL, "gx", "gz"), keyed, ["gx", "gz"], ["op_id"]).where(
        F.col("vx").between(F.col("x0"), F.col("x1"))
        & F.col("vy").between(F.col("y0"), F.col("y1"))
        & F.col("vz").between(F.col("z0"), F.col("z1"))
    )
    # Parcels do not overlap once claims are validated; the lowest id decides otherwise.
    held = inside.groupBy("op_id").agg(F.min_by(F.struct("parcel_id", "owner", "author"), "parcel_id").alias("_p"))
    held = held.select("op_id", "_p.parcel_id", "_p.owner", F.col("_p.author").alias("grantee"))
    granted = held.join(grants.select("parcel_id", "grantee").distinct(), ["parcel_id", "grantee"], "left_semi").select(
        "op_id", F.lit(True).alias("granted")
    )
    out = ops.join(held.drop("grantee"), "op_id", "left").join(granted, "op_id", "left")
    return out.withColumn(
        "allowed",
        F.col("owner").isNull() | (F.col("owner") == F.col("author")) | F.coalesce("granted", F.lit(False)),
    ).drop("granted")


def parcel_conflicts(claims: DataFrame) -> DataFrame:
    """Pairs (seq, earlier) of claims whose boxes overlap, found on a hierarchy of grids."""
    pairs = box_pairs(claims, "seq", ["x0", "z0", "y0"], ["x1", "z1", "y1"], 16.0)
    return pairs.select(F.greatest("a", "b").alias("seq"), F.least("a", "b").alias("earlier"))


def accept_claims(claims: DataFrame) -> DataFrame:
    """Claims accepted in order of ``seq``: a claim stands when no accepted earlier one overlaps it.

    Rounds settle every claim whose earlier rivals are settled.  The number of rounds is the longest chain of
    overlapping claims in rising order.
    """
    from ..session import cut_lineage

    pairs = cut_lineage(parcel_conflicts(claims))
    open_ = cut_lineage(claims.select("seq"))
    accepted = claims.select("seq").where(F.lit(False))
    while open_.limit(1).count():
        live = pairs.join(open_, "seq", "left_semi")
        waits = live.join(open_.select(F.col("seq").alias("earlier")), "earlier", "left_semi").select("seq").distinct()
        beaten = live.join(accepted.select(F.col("seq").alias("earlier")), "earlier", "left_semi").select("seq").distinct()
        new = open_.join(waits, "seq", "left_anti").join(beaten, "seq", "left_anti")
        accepted = cut_lineage(accepted.union(new))
        open_ = cut_lineage(open_.join(accepted, "seq", "left_anti").join(beaten, "seq", "left_anti"))
    return claims.join(accepted, "seq", "left_semi")


def op_stats(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Received, applied and rejected counts, per author or in all."""
    ok = F.col("result") == "Allowed"
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"), F.count_if(ok).alias("applied"), F.count_if(~ok).alias("rejected")
    )


def offender_block(results: DataFrame, limit: int = 5) -> DataFrame:
    """Authors with at least ``limit`` denied ops."""
    denied = results.where(F.col("result") != "Allowed").groupBy("author").agg(F.count(F.lit(1)).alias("denied"))
    return denied.where(F.col("denied") >= limit)


def clock_merge_agg(ops: DataFrame, keys: Sequence[str] = (), clock: str = "clock") -> DataFrame:
    """Pointwise maximum of many clocks, as rows ``(keys, peer, n)``; see ``clock_rows_to_map``."""
    return ops.select(*keys, F.explode(clock).alias("peer", "n")).groupBy(*keys, "peer").agg(F.max("n").alias("n"))


def lamport_tick(events: DataFrame, keys: Sequence[str], order: str, received: str) -> DataFrame:
    """Local clock after each receive, ``max(local, received) + 1`` along ``order``.

    After k receives the clock is the maximum over earlier i of ``received_i + (k - i) + 1``, so it is a running
    maximum of ``received - position`` plus the position.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ranked = events.withColumn("_k", F.row_number().over(w))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(
        "clock", big(F.greatest(F.max(F.col(received) - F.col("_k")).over(run) + F.col("_k") + 1, F.col("_k")))
    ).drop("_k")


def manifest_diff(mine: DataFrame, peer: DataFrame) -> DataFrame:
    """Chunks held here that are newer than the peer's copy; a missing copy counts as time 0."""
    joined = mine.join(peer.select("chunk", F.col("updated").alias("_theirs")), "chunk", "left")
    return joined.where(F.coalesce("_theirs", F.lit(0)) < F.col("updated")).drop("_theirs")
