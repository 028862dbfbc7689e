"""Position streams in batch form: delta filter, smoothing, presence, distances and links."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_lerp, big, clamp, col, region_id, region_topic, subscribe_topics
from ..session import cut_lineage
from .skew import pick_rank, pieces, prev_known, salted_join, shuffled

# Fixed values.
MOVE_M = 0.05
TURN_RAD = 0.017
KEEPALIVE_MS = 500
DELAY_MS = 100
STALE_MS = 5000
TIER_M = (100.0, 500.0, 1000.0)
RTT_WINDOW = 5
UPGRADE_AFTER = 3
PROFILES = ["LAN", "Normal", "Constrained", "Auto"]
PROFILE_RANK = {"LAN": 0, "Normal": 1, "Constrained": 2, "Auto": 1}
POSITION_HZ = {"LoRa": 0.0, "Constrained": 2.0, "Normal": 10.0, "LAN": 20.0, "Auto": 20.0}
PRIORITY = {"Critical": 0, "High": 1, "Normal": 2, "Low": 3}
MAX_PRIORITY = {"LoRa": 0, "Constrained": 1, "Normal": 3, "LAN": 3, "Auto": 3}

STATE_FIELDS = ["x", "y", "z", "vx", "vy", "vz", "yaw", "pitch"]


def millis(ts) -> Column:
    return F.unix_millis(col(ts).cast("timestamp"))


def day(ts) -> Column:
    """Day number of a time, the bucket for hot peers."""
    return F.floor(millis(ts) / 86400000)


def needs_send(last: dict | None, row: dict) -> bool:
    """Whether a position differs enough from the last one sent."""
    if last is None:
        return True
    moved = sum((row[a] - last[a]) ** 2 for a in "xyz") ** 0.5
    return (
        moved > MOVE_M or abs(row["yaw"] - last["yaw"]) > TURN_RAD or abs(row["pitch"] - last["pitch"]) > TURN_RAD
        or row["mode"] != last["mode"] or row["ms"] - last["ms"] >= KEEPALIVE_MS
    )


def delta_filter(positions: DataFrame, key: str = "peer", order: str = "seq") -> DataFrame:
    """Positions worth sending, each compared with the last kept one: key, seq, ms, x, y, z, yaw, pitch, mode.

    A row at least 500 ms after the one before it is always kept, so such gaps cut a peer's rows into runs that do
    not depend on each other; runs are spread over tasks and read in batches.
    """
    gap = prev_known(positions, [key], F.floor(F.col("ms") / 3600000), [order], F.col("ms"), "_prev")
    cut = F.coalesce((F.col("ms") - F.col("_prev") >= KEEPALIVE_MS), F.lit(True))
    marked = prev_known(gap.withColumn("_cut", cut), [key], F.floor(F.col("ms") / 3600000), [order],
                        F.when(F.col("_cut"), F.col(order)), "run", strict=False)
    cols = [c for c in positions.columns]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            kept = []
            for i, row in enumerate(pdf.to_dict("records")):
                if needs_send(last, row):
                    last = row
                    kept.append(i)
            yield pdf.iloc[kept][cols]

    runs = marked.select(*cols, "run").repartition(key, "run").sortWithinPartitions(key, "run", order)
    return runs.groupBy(key, "run").applyInPandas(keep, positions.schema)


def staleness(positions: DataFrame, as_of, key: str = "peer") -> DataFrame:
    """Last update per peer and whether it is older than five seconds."""
    last = positions.groupBy(key).agg(F.max("ts").alias("last_ts"))
    return last.withColumn("stale", millis(as_of) - millis("last_ts") > STALE_MS)


def presence_sessions(positions: DataFrame, key: str = "peer", gap: str = "5 seconds") -> DataFrame:
    """Spans of activity separated by silence of at least ``gap``."""
    s = positions.groupBy(key, F.session_window("ts", gap).alias("_s")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("end"))
    return s.select(key, F.col("_s.start").alias("start"), "end", "n")


def lag_motion(positions: DataFrame, key: str = "peer", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Distance and turn from the previous state."""
    out = prev_known(positions, [key], day("ts"), order, F.struct("x", "y", "z", "yaw"), "_p")
    d = [F.col(a) - F.col(f"_p.{a}") for a in "xyz"]
    return out.withColumn("moved_m", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).withColumn(
        "turned", F.abs(F.col("yaw") - F.col("_p.yaw"))
    ).drop("_p")


def as_of_states(states: DataFrame, asks: DataFrame, key: str = "peer", delay_ms: int = DELAY_MS) -> DataFrame:
    """Smoothed state per ask ``(key, ask_id, ts)``: between the two states around ``ts - delay``.

    With only earlier states the last one moves on by its velocity; with only later ones the first is taken; two
    states under a millisecond apart give the later.  States and asks are sorted together once per (peer, day).
    """
    s = states.select(
        key, millis("ts").alias("_ms"), F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("ask_id"),
        F.struct(millis("ts").alias("ms"), *STATE_FIELDS).alias("_state"), big(F.col("seq")).alias("_seq"),
    )
    a = asks.select(
        key, (millis("ts") - delay_ms).alias("_ms"), F.lit(1).alias("_kind"), "ask_id",
        F.lit(None).cast(s.schema["_state"].dataType).alias("_state"), F.lit(0).cast("bigint").alias("_seq"),
    )
    both = s.unionByName(a)
    bucket, order = F.floor(F.col("_ms") / 86400000), ["_ms", "_kind", "_seq", "ask_id"]
    both = both.withColumn("ask_id", F.coalesce("ask_id", F.lit(-1)))
    prev = prev_known(both, [key], bucket, order, F.col("_state"), "_p")
    around = prev_known(prev, [key], bucket, order, F.col("_state"), "_n", forward=True).where(F.col("_kind") == 1)
    p, n, t = F.col("_p"), F.col("_n"), F.col("_ms")
    span = (n["ms"] - p["ms"]) / 1000.0
    alpha = clamp((t - p["ms"]) / F.greatest(n["ms"] - p["ms"], F.lit(1)).cast("double"), 0.0, 1.0)
    ahead = (t - p["ms"]) / 1000.0
    out = []
    for f in STATE_FIELDS:
        mid = angle_lerp(p[f], n[f], alpha) if f in ("yaw", "pitch") else p[f] + (n[f] - p[f]) * alpha
        on = p[f] + p[f"v{f}"] * ahead if f in "xyz" else p[f]
        value = (
            F.when(p.isNotNull() & n.isNotNull(), F.when(span < 0.001, n[f]).otherwise(mid))
            .when(p.isNotNull(), on)
            .otherwise(n[f])
        )
        out.append(value.alias(f))
    how = F.when(p.isNotNull() & n.isNotNull(), "between").when(p.isNotNull(), "ahead").when(n.isNotNull(), "first").otherwise("none")
    return around.select(key, "ask_id", how.alias("how"), *out)


def region_change(positions: DataFrame, key: str = "peer", order: Sequence[str] = ("ts", "seq"), level: int = 3) -> DataFrame:
    """Rows where a peer's region differs from the one before; the first row counts."""
    r = positions.withColumn("region", region_id("lat", "lon", level))
    out = prev_known(r, [key], day("ts"), order, F.col("region"), "_was")
    return out.where(~F.col("region").eqNullSafe(F.col("_was"))).drop("_was")


def region_fanout(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Deliver each event to the subscribers of its region's topic.

    ``subscribers``: subscriber, lat, lon; each takes the 3x3 regions around it and around its parent.
    """
    topics = subscribers.select("subscriber", F.explode(subscribe_topics(region_id("lat", "lon", 3))).alias("topic"))
    return salted_join(routed(events), topics, ["topic"], ["event_id"])


def routed(events: DataFrame) -> DataFrame:
    """Events (a table or a stream, with ``lat, lon``) with the topic of their region."""
    return events.withColumn("topic", region_topic(region_id("lat", "lon", 3)))


def fanout_counts(routed_events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Deliveries ``n`` of each subscriber, from counts per topic: no pair of event and subscriber is formed."""
    per_topic = routed_events.groupBy("topic").agg(F.count(F.lit(1)).alias("_n"))
    topics = subscribers.select("subscriber", F.explode(subscribe_topics(region_id("lat", "lon", 3))).alias("topic"))
    return topics.join(per_topic, "topic").groupBy("subscriber").agg(F.sum("_n").alias("n"))


# ---------------------------------------------------------------------------------------------------------
# Proximity
# ---------------------------------------------------------------------------------------------------------
def tier_of(dist) -> Column:
    d = col(dist)
    return F.when(d <= TIER_M[0], 1).when(d <= TIER_M[1], 2).when(d <= TIER_M[2], 3).otherwise(4).cast("bigint")


def _distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _cell_keys(prefix: str, size) -> list[Column]:
    return [big(F.floor(F.col(f"{prefix}{c}") / size)).alias(f"g{c}") for c in "xyz"]


def _named(df: DataFrame, ident: str, prefix: str) -> DataFrame:
    return df.select(F.col("peer").alias(ident), *[F.col(c).alias(f"{prefix}{c}") for c in "xyz"])


#: Observers in one list of those at a place; a place with more has several lists.
PLACE_IDS = 1024
#: Parts that the peers of a cell are dealt to.
CELL_PARTS = 32


def _observer_lists(observers: DataFrame) -> DataFrame:
    """Places ``ox, oy, oz`` with lists ``_observers`` of those there."""
    at, named = ["ox", "oy", "oz"], _named(observers, "observer", "o")
    crowded = named.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / PLACE_IDS).alias("_lists")).where(F.col("_lists") > 1)
    dealt = named.join(shuffled(crowded), at, "left").withColumn("_list", F.pmod(F.xxhash64("observer"), F.coalesce("_lists", F.lit(1))))
    return dealt.groupBy(*at, "_list").agg(F.sort_array(F.collect_list("observer")).alias("_observers")).drop("_list")


def proximity_pairs(observers: DataFrame, peers: DataFrame, radius_m: float = TIER_M[-1], digits: int | None = None) -> DataFrame:
    """(observer, peer, dist_m, tier) within the bounded tiers; both inputs are ``peer, x, y, z``.

    Observers at one place are a list, whose distance to a peer is taken (and rounded to ``digits``) once.  They probe the 27
    cells around them, so only near pairs are formed.  The peers of a cell are dealt to parts and the number of partitions is
    fixed, as what enters is small beside the pairs.  A list meets all peers of a part one after the other, so the rows of a
    task repeat the same ids in the same order, which stores in a fraction of the space.
    """
    parts, key = int(observers.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["gx", "gy", "gz", "_part"]
    span = F.sequence(F.lit(-1), F.lit(1))
    placed = _named(peers, "peer", "p").select("*", *_cell_keys("p", radius_m))
    probe = _observer_lists(observers).select("*", *_cell_keys("o", radius_m))
    for c in "xyz":
        probe = probe.withColumn("_d", F.explode(span)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("_d")).drop("_d")
    probe = probe.join(shuffled(placed.select(*key[:3]).distinct()), key[:3], "left_semi")
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("peer"), F.lit(CELL_PARTS)).cast("int")).repartition(parts, *key)
    probe = probe.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(CELL_PARTS - 1)))).repartition(parts, *key)
    near = probe.join(shuffled(placed), key).withColumn("dist_m", _distance("o", "p")).where(F.col("dist_m") <= radius_m)
    shown = F.col("dist_m") if digits is None else F.round("dist_m", digits)
    near = near.select("_observers", "peer", shown.alias("dist_m"), tier_of("dist_m").alias("tier"))
    pairs = near.select(F.explode("_observers").alias("observer"), "peer", "dist_m", "tier")
    return pairs.where(F.col("observer") != F.col("peer"))


def tier_counts(observers: DataFrame, peers: DataFrame) -> DataFrame:
    """Peers per tier for each observer; ``peers`` also has ``is_relay``."""
    near = proximity_pairs(observers, peers).groupBy("observer").pivot("tier", [1, 2, 3]).agg(F.count(F.lit(1)))
    total = peers.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_relay").alias("relays"))
    rows = observers.select(F.col("peer").alias("observer")).join(near, "observer", "left").withColumn("_k", F.lit(0))
    out = rows.join(F.broadcast(total.withColumn("_k", F.lit(0))), "_k")  # one row
    t = [F.coalesce(F.col(str(i)), F.lit(0)) for i in (1, 2, 3)]
    return out.select(
        "observer", t[0].alias("tier1"), t[1].alias("tier2"), t[2].alias("tier3"),
        (F.col("total") - 1 - t[0] - t[1] - t[2]).alias("tier4"), "relays",
    )


def tiered_top_k(observers: DataFrame, peers: DataFrame, k: int = 5, base_m: float = 50.0, levels: int = 20) -> DataFrame:
    """The k nearest peers of each observer with their tier: nearer tiers fill first, then distance, then id.

    Equal places are searched once: of the peers at one place only the k + 1 with the smallest ids can count, and
    observers at one place share their k + 1 nearest, of which each leaves itself out.  A place is searched at the
    finest grid whose cell around it holds more than k peers: those lie within the cell's diagonal, so the search radius
    is known to be enough and crowded places search a small one.  Observers are taken to be among the peers.
    """
    sizes = [base_m * 2.0**i for i in range(levels)]
    at = ["ox", "oy", "oz"]

    def keyed(df, prefix):
        cells = F.array(*[F.struct(F.lit(i).alias("gl"), *_cell_keys(prefix, s)) for i, s in enumerate(sizes)])
        return df.withColumn("_g", F.explode(cells)).select("*", "_g.*").drop("_g")

    same = Window.partitionBy("px", "py", "pz").orderBy("peer")
    few = _named(peers, "peer", "p").withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k + 1).drop("_rn")
    placed = keyed(few, "p")
    counts = placed.groupBy("gl", "gx", "gy", "gz").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k)
    places = _named(observers, "observer", "o").select(*at).distinct()
    level = keyed(places, "o").join(shuffled(counts), ["gl", "gx", "gy", "gz"], "left_semi").groupBy(*at).agg(F.min("gl").alias("gl"))
    level = places.join(shuffled(level), at, "left").withColumn("gl", F.coalesce("gl", F.lit(levels - 1)))
    size = F.lit(base_m) * F.pow(F.lit(2.0), F.col("gl"))
    # The diagonal of a cell is under 1.75 sides, so two cells each way cover it.
    span = F.sequence(F.lit(-2), F.lit(2))
    probe = level.select("*", *_cell_keys("o", size))
    for c in "xyz":
        probe = probe.withColumn("_d", F.explode(span)).withColumn(f"g{c}", F.col(f"g{c}") + F.col("_d")).drop("_d")
    hits = placed.join(shuffled(probe), ["gl", "gx", "gy", "gz"]).withColumn("dist_m", _distance("o", "p"))
    hits = hits.withColumn("tier", tier_of("dist_m"))
    w = Window.partitionBy(*at).orderBy("tier", "dist_m", "peer")
    near = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1).select(*at, "peer", "dist_m", "tier")
    mine = _named(observers, "observer", "o").join(shuffled(near), at).where(F.col("observer") != F.col("peer"))
    w = Window.partitionBy("observer").orderBy("tier", "dist_m", "peer")
    ranked = mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("observer", "peer", "dist_m", "tier", big(F.col("rank")).alias("rank"))


def sample_fraction(df: DataFrame, ident: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """A random ceil(fraction) of the rows, at least one: those whose hash is at most the hash of that rank."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(ident), F.lit(seed)).cast("double"))
    rank = F.greatest(F.ceil(F.col("n") * fraction), F.lit(1)) - 1
    cut = pick_rank(hashed, [], "_h", rank, "_cut").select("_cut")
    return hashed.join(F.broadcast(cut), F.col("_h") <= F.col("_cut"), "left_semi").drop("_h")  # one row


# ---------------------------------------------------------------------------------------------------------
# Links
# ---------------------------------------------------------------------------------------------------------
def rtt_class(rtt_ms) -> Column:
    r = col(rtt_ms)
    return F.when(r < 5.0, "LAN").when(r < 50.0, "Normal").otherwise("Constrained")


def rtt_median5(samples: DataFrame, piece_rows: int = 100000) -> DataFrame:
    """Upper median of the last five samples per link; ``seq`` counts from 1 without gaps.

    Links are cut into pieces with four rows of overlap, so one long link runs on many tasks.
    """
    cut = pieces(samples, ["link"], "seq", piece_rows, RTT_WINDOW - 1)
    w = Window.partitionBy("link", "piece").orderBy("seq").rowsBetween(-(RTT_WINDOW - 1), 0)
    last = F.sort_array(F.collect_list("rtt_ms").over(w))
    out = cut.withColumn("median_ms", F.element_at(last, (F.floor(F.size(last) / 2) + 1).cast("int")))
    return out.where(~F.col("is_halo")).drop("is_halo")


def _step(profile: int, streak: int, candidate: int) -> tuple[int, int]:
    """Next (profile, streak) of the link state: down at once, up on the third better sample in a row."""
    now, new = PROFILE_RANK[PROFILES[profile]], PROFILE_RANK[PROFILES[candidate]]
    if new < now:
        return (candidate, 0) if streak + 1 >= UPGRADE_AFTER else (profile, streak + 1)
    return (candidate, 0) if new > now else (profile, 0)


# State number = profile * UPGRADE_AFTER + streak; one row per state, one column per candidate.
TRANSITION = np.array(
    [
        [(lambda s: s[0] * UPGRADE_AFTER + s[1])(_step(p, k, c)) for c in range(3)]
        for p in range(len(PROFILES)) for k in range(UPGRADE_AFTER)
    ]
)
# One more column leaves the state as it is.
IDLE = TRANSITION.shape[1]
TRANSITION = np.column_stack([TRANSITION, np.arange(len(TRANSITION))])
START = PROFILES.index("Auto") * UPGRADE_AFTER


def _rows_of_steps(cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in rows of about the square root of their number, and the map of each row from start to end state.

    All rows step together, so the work in Python grows with the square root.
    """
    width = max(1, math.isqrt(len(cand)))
    grid = np.full(-(-len(cand) // width) * width, IDLE)
    grid[: len(cand)] = cand
    grid = grid.reshape(-1, width)
    ends = np.tile(np.arange(len(TRANSITION)), (len(grid), 1))
    for c in grid.T:
        ends = TRANSITION[ends, c[:, None]]
    return grid, ends


def steps_map(cand: np.ndarray) -> np.ndarray:
    """The state after all candidates, for each state before them."""
    state = np.arange(len(TRANSITION))
    for row in _rows_of_steps(cand)[1]:
        state = row[state]
    return state


def steps_taken(cand: np.ndarray, start: int) -> np.ndarray:
    """The state after each candidate."""
    grid, ends = _rows_of_steps(cand)
    state = np.empty(len(grid), int)
    for i, row in enumerate(ends):
        state[i], start = start, row[start]
    out = np.empty(grid.shape, int)
    for j, c in enumerate(grid.T):
        state = out[:, j] = TRANSITION[state, c]
    return out.ravel()[: len(cand)]


class PieceSteps:
    """The steps of many pieces that follow each other in ``cand`` and begin at ``first``.

    Pieces are laid out in rows of ``width``, of which all step together; the maps of a piece's rows are then chained by
    doubling, so the work in Python does not grow with the number of pieces.
    """

    def __init__(self, cand: np.ndarray, first: np.ndarray, width: int = 64):
        size = np.diff(np.append(first, len(cand)))
        rows = -(-size // width)
        self.begin = np.cumsum(rows) - rows  # the first row of each piece
        at = np.arange(len(cand)) - np.repeat(first, size)
        self.row, self.column = np.repeat(self.begin, size) + at // width, at % width
        self.grid = np.full((rows.sum(), width), IDLE)
        self.grid[self.row, self.column] = cand
        self.piece = np.repeat(np.arange(len(first)), rows)
        ends = np.tile(np.arange(len(TRANSITION)), (len(self.grid), 1))
        for c in self.grid.T:
            ends = TRANSITION[ends, c[:, None]]
        nth, step = np.arange(len(self.grid)) - self.begin[self.piece], 1
        while step <= nth.max(initial=0):
            i = np.flatnonzero(nth >= step)
            ends[i] = np.take_along_axis(ends[i], ends[i - step], 1)
            step *= 2
        self.ends = ends  # from the start of the piece to the end of each row

    def maps(self) -> np.ndarray:
        """The state after each piece, for each state before it."""
        return self.ends[np.append(self.begin[1:], len(self.grid)) - 1]

    def taken(self, start: np.ndarray) -> np.ndarray:
        """The state after each candidate, with the state before each piece."""
        state = start[self.piece].astype(int)
        later = np.setdiff1d(np.arange(len(self.grid)), self.begin)
        state[later] = self.ends[later - 1, state[later]]
        out = np.empty(self.grid.shape, int)
        for j, c in enumerate(self.grid.T):
            state = out[:, j] = TRANSITION[state, c]
        return out[self.row, self.column]


def chain_maps(maps: DataFrame, key: str, at: str, start: int, block: int = 1024) -> DataFrame:
    """State before each map (``key``, ``at``, ``map``: array from state to state) when those of a key follow each other.

    A scan on two levels: maps of a block become one map, blocks are chained, and each block is then gone through from
    its own start; work is linear and a row holds one block.
    """
    number = F.floor(F.col(at) / block)
    blocks = maps.groupBy(key, number.alias("_block")).agg(F.sort_array(F.collect_list(F.struct(at, "map"))).alias("_maps"))
    same = F.transform(F.element_at("_maps", 1)["map"], lambda _, i: i)
    ends = blocks.select(key, "_block", F.aggregate("_maps", same, lambda s, m: F.transform(s, lambda x: F.element_at(m["map"], x + 1))).alias("map"))

    def starts(rows: Column, first: Column, place: str) -> Column:
        """An entry a map with the state before it."""
        empty = F.array().cast(f"array<struct<{place}:bigint,start:int>>")
        begin = F.struct(first.cast("int").alias("state"), empty.alias("seen"))
        step = lambda s, m: F.struct(
            F.element_at(m["map"], s["state"] + 1).alias("state"),
            F.concat(s["seen"], F.array(F.struct(m[place].cast("bigint").alias(place), s["state"].alias("start")))).alias("seen"),
        )
        return F.inline(F.aggregate(rows, begin, step, lambda s: s["seen"]))

    whole = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_block", "map"))).alias("_blocks"))
    begun = whole.select(key, starts(F.col("_blocks"), F.lit(start), "_block")).withColumnRenamed("start", "_start")
    return blocks.join(begun, [key, "_block"]).select(key, starts(F.col("_maps"), F.col("_start"), at))


def link_profile(samples: DataFrame, piece_rows: int = 100000, block: int = 1024) -> DataFrame:
    """Profile of each link after each sample.

    The link state is a small automaton, so a piece of a link is a map from start state to end state.  Pieces are
    mapped in parallel, the maps are chained on two levels, and each piece is then replayed from its true start.  Batches
    hold many pieces, as a call of Python a piece costs more than its steps.
    """
    medians = rtt_median5(samples, piece_rows).withColumn("cand", F.array_position(F.array(*[F.lit(p) for p in PROFILES[:3]]), rtt_class("median_ms")) - 1)
    steps = medians.where(F.col("link").isNotNull()).select("link", "piece", "seq", "median_ms", F.col("cand").cast("int").alias("cand"))
    order = ["link", "piece", "seq"]

    def to_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # key and map of the last piece, which may go on in the next batch
        for pdf in filter(len, batches):
            first, keys = _piece_starts(pdf)
            maps = PieceSteps(pdf["cand"].to_numpy(), first).maps()
            if held and held[0] == keys[0]:
                maps[0] = maps[0][held[1]]
            elif held:
                yield _map_rows([held[0]], [held[1]])
            held = keys[-1], maps[-1]
            if len(keys) > 1:
                yield _map_rows(keys[:-1], maps[:-1])
        if held:
            yield _map_rows([held[0]], [held[1]])

    # The window of the medians leaves a piece's rows in one partition and in order.
    maps = steps.sortWithinPartitions(*order).mapInPandas(to_maps, "link bigint, piece bigint, map array<int>")
    start = chain_maps(cut_lineage(maps), "link", "piece", START, block)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # key and state of the last piece
        for pdf in filter(len, batches):
            first, keys = _piece_starts(pdf)
            begin = pdf["start"].to_numpy()[first]
            if held and held[0] == keys[0]:
                begin[0] = held[1]
            out = PieceSteps(pdf["cand"].to_numpy(), first).taken(begin)
            held = keys[-1], int(out[-1])
            yield pd.DataFrame({"link": pdf["link"], "seq": pdf["seq"], "median_ms": pdf["median_ms"], "profile": np.array(PROFILES)[out // UPGRADE_AFTER]})

    placed = steps.join(start, ["link", "piece"]).repartition("link", "piece").sortWithinPartitions(*order)
    return placed.mapInPandas(replay, "link bigint, seq bigint, median_ms double, profile string")


def _piece_starts(pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Where the pieces of a sorted batch begin, and their keys."""
    link, piece = pdf["link"].to_numpy(), pdf["piece"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (link[1:] != link[:-1]) | (piece[1:] != piece[:-1])]))
    return first, list(zip(link[first].tolist(), piece[first].tolist()))


def _map_rows(keys: Sequence[tuple[int, int]], maps: Sequence[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"link": [k for k, _ in keys], "piece": [p for _, p in keys], "map": [m.tolist() for m in maps]})


def message_gate(messages: DataFrame) -> DataFrame:
    """Messages a link's profile lets through, by priority; adds the profile's position rate."""
    from ..functions.rules import lookup

    ok = lookup("priority", PRIORITY) <= lookup("profile", MAX_PRIORITY)
    return messages.where(ok).withColumn("position_hz", lookup("profile", POSITION_HZ))


#: States that smoothing looks back on.
HISTORY = 10


def position_smooth(positions: DataFrame, delay_ms: int = 100) -> DataFrame:
    """Position ``delay_ms`` before the newest time sent, at each state, from the last ``HISTORY`` states by Lamport time.

    Between the last state before that moment and the first after it the position is interpolated; with none after it,
    it moves on by velocity; with none before it, it is the first one.
    """
    fields = ["lamport", "ms", "x", "y", "z", "vx", "vy", "vz"]
    w = Window.partitionBy("peer").orderBy("lamport", "ms").rowsBetween(1 - HISTORY, 0)
    df = positions.select("peer", "lamport", F.collect_list(F.struct(*fields)).over(w).alias("_h"))
    df = df.withColumn("ms", F.array_max(F.transform("_h", lambda e: e["ms"])) - delay_ms)
    df = df.withColumn("_a", F.try_element_at(F.filter("_h", lambda e: e["ms"] <= F.col("ms")), F.lit(-1)))
    df = df.withColumn("_b", F.try_element_at(F.filter("_h", lambda e: e["ms"] > F.col("ms")), F.lit(1)))
    a, b, past = F.col("_a"), F.col("_b"), (F.col("ms") - F.col("_a.ms")).cast("double")

    def along(c):
        between = a[c] + (b[c] - a[c]) * (past / F.greatest((b["ms"] - a["ms"]).cast("double"), F.lit(1.0)))
        return F.when(a.isNotNull() & b.isNotNull(), between).when(a.isNotNull(), a[c] + a[f"v{c}"] * (past / 1000.0)).otherwise(b[c]).alias(c)

    return df.select("peer", "lamport", "ms", *[along(c) for c in "xyz"])
