"""Streaming jobs on edits, positions, keys and content."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geo import region_id
from ..operators import directory as dr, oplog as ol
from ..operators.motion import HISTORY, PROFILES, STALE_MS, START, TRANSITION, UPGRADE_AFTER, needs_send, region_fanout, rtt_class
from .runner import run_to_parquet, run_upserts

LATE = "10 minutes"


def stream_ops(ops: DataFrame, keys: DataFrame, as_of, late: str | None = None) -> DataFrame:
    """Allowed ops of a stream, each once, by the checks of the batch operator.

    ``ops``: op_id, author, action, sig_ok, ts, ...; ``keys`` is a static table with self_sig_ok.  All ids are
    remembered, so late ops count however the input is cut into batches; ``late`` bounds that memory and gives up ops
    that come later.
    """
    k = keys.select(F.col("peer").alias("author"), "key_type", "expires_at", "revoked", "self_sig_ok")
    once = ops.dropDuplicates(["op_id"]) if late is None else ops.withWatermark("ts", late).dropDuplicatesWithinWatermark(["op_id"])
    j = once.join(k, "author", "left")
    ok = (
        F.col("sig_ok") & F.coalesce("self_sig_ok", F.lit(True)) & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce(F.col("expires_at") < as_of, F.lit(False))
        & ol.class_allows(F.coalesce("key_type", F.lit("Guest")), ol.action_class("action"))
    )
    return j.where(ok).drop("key_type", "expires_at", "revoked", "self_sig_ok")


def stream_lww(ops: DataFrame, name: str = "lww") -> DataFrame:
    """Register per voxel from a stream; batches and replays in any order give the same table."""
    cols = ["vx", "vy", "vz", "op_id", "author", "lamport", "material"]

    def merge(table, batch):
        rows = batch.select(*cols)
        return ol.lww_register(rows if table is None else table.select(*cols).unionByName(rows))

    return run_upserts(ops, name, merge, ["vx", "vy", "vz"])


def stream_late_ops(ops: DataFrame, name: str = "late") -> tuple[DataFrame, DataFrame]:
    """Raw log and register of one stream: losers and late ops stay in the log and never change the register.

    Both sinks read the same source with their own progress; the register ignores what the winner beats.
    """
    return run_to_parquet(ops, f"{name}-log"), stream_lww(ops, f"{name}-register")


def op_rate_windows(ops: DataFrame, window: str = "60 seconds", late: str = LATE) -> DataFrame:
    """Ops per author and window, final once the watermark has passed."""
    w = ops.withWatermark("ts", late).groupBy("author", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("author", F.col("w.start").alias("start_ts"), "n")


def offender_block(denied: DataFrame, limit: int = 5, name: str = "offenders") -> DataFrame:
    """Authors with at least ``limit`` denied ops so far, as an upserted count table."""

    def merge(table, batch):
        new = batch.groupBy("author").agg(F.count(F.lit(1)).alias("denied"))
        both = new if table is None else table.unionByName(new)
        return both.groupBy("author").agg(F.sum("denied").alias("denied"))

    return run_upserts(denied, name, merge, ["author"]).where(F.col("denied") >= limit)


POSITION_OUT = "peer bigint, seq bigint, ms bigint, x double, y double, z double, yaw double, pitch double, mode string"


def in_order(batches: Iterable[pd.DataFrame], names: list[str], order: str, size: int = 10_000) -> Iterator[pd.DataFrame]:
    """Rows of a key in order of a column, a part at a time.

    What is held whole are Arrow columns, as Python objects for all rows of a key with much input would fill the worker.
    """
    parts = [pa.Table.from_pandas(b[names], preserve_index=False) for b in batches]
    rows = pa.concat_tables(parts, promote_options="permissive").combine_chunks()
    del parts
    at = np.argsort(rows[order].to_numpy(), kind="stable")
    for low in range(0, len(at), size):
        yield rows.take(at[low : low + size]).to_pandas()


def position_delta(positions: DataFrame) -> DataFrame:
    """Positions worth sending, with the last sent one of each peer as state.

    ``positions``: the columns of POSITION_OUT.  Rows of a batch are taken in order of ``seq``.
    """
    names = [c.split()[0] for c in POSITION_OUT.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(names, state.get)) if state.exists else None
        for rows in in_order(batches, names, "seq"):
            kept = []
            for i, row in enumerate(rows.to_dict("records")):
                if needs_send(last, row):
                    last = row
                    kept.append(i)
            yield rows.iloc[kept]
        state.update(tuple(_plain(last[n]) for n in names))

    return positions.groupBy("peer").applyInPandasWithState(step, POSITION_OUT, POSITION_OUT, "append", GroupStateTimeout.NoTimeout)


def _plain(v):
    return v.item() if hasattr(v, "item") else v


SMOOTH_OUT = "peer bigint, lamport bigint, ms bigint, x double, y double, z double"


def position_smooth(positions: DataFrame, delay_ms: int = 100) -> DataFrame:
    """Position of each peer ``delay_ms`` before the newest time it has sent, at each of its states.

    One row a state, from the last ``HISTORY`` states up to it by Lamport time, as ``motion.position_smooth`` gives it;
    with states in order the result does not depend on how the input is cut into batches.  ``positions``: peer,
    lamport, ms, x, y, z, vx, vy, vz.
    """
    fields = ["lamport", "ms", "x", "y", "z", "vx", "vy", "vz"]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(batches)[fields].sort_values(["lamport", "ms"]).to_numpy(dtype=float)
        old = np.array(state.get).T if state.exists else np.zeros((0, len(fields)))
        rows = np.concatenate([old, new])
        state.update(tuple(c.tolist() for c in rows[-HISTORY + 1:].T))
        seen = np.arange(len(old), len(rows))[:, None] + np.arange(1 - HISTORY, 1)
        there = seen >= 0
        h = rows[np.maximum(seen, 0)]
        at = np.where(there, h[:, :, 1], -np.inf).max(1) - delay_ms
        before, after = there & (h[:, :, 1] <= at[:, None]), there & (h[:, :, 1] > at[:, None])
        each = np.arange(len(h))
        a, b = h[each, HISTORY - 1 - before[:, ::-1].argmax(1)], h[each, after.argmax(1)]
        t = ((at - a[:, 1]) / np.maximum(b[:, 1] - a[:, 1], 1.0))[:, None]
        between, onward = a[:, 2:5] + (b[:, 2:5] - a[:, 2:5]) * t, a[:, 2:5] + a[:, 5:8] * ((at - a[:, 1]) / 1000.0)[:, None]
        some, more = before.any(1)[:, None], after.any(1)[:, None]
        xyz = np.where(some & more, between, np.where(some, onward, b[:, 2:5]))
        yield pd.DataFrame({"peer": key[0], "lamport": new[:, 0].astype("int64"), "ms": at.astype("int64"), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    schema = ", ".join(f"{f} array<double>" for f in fields)
    return positions.groupBy("peer").applyInPandasWithState(step, SMOOTH_OUT, schema, "append", GroupStateTimeout.NoTimeout)


def presence_timeout(positions: DataFrame, silent: str = f"{STALE_MS // 1000} seconds", late: str = LATE) -> DataFrame:
    """Spans of presence per peer, closed after a silence; emitted once the watermark has passed their end."""
    s = positions.withWatermark("ts", late).groupBy("peer", F.session_window("ts", silent).alias("_s")).agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")
    )
    return s.select("peer", F.col("_s.start").alias("start"), "last_ts", "n")


PRESENCE_OUT = "peer bigint, event string, at timestamp"


def presence_events(positions: DataFrame, silent_ms: int = STALE_MS, late: str = LATE) -> DataFrame:
    """``here`` when a peer appears and ``gone`` when ``silent_ms`` have passed since its last position, by event-time timers.

    ``positions``: peer, ts.  A peer's state is the time of its last position and one timer; the timer fires when the
    watermark (``late`` behind the newest position of any peer) passes it, also without new rows of the peer.  Rows
    that come late, but before the watermark, move nothing back; of one batch only silences between rows are told.
    """
    def told(peer, rows: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"peer": peer, "event": [e for e, _ in rows], "at": pd.to_datetime([t for _, t in rows], unit="ms")}, columns=["peer", "event", "at"])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield told(key[0], [("gone", last + silent_ms)])
            return
        last, out = (state.get[0] if state.exists else None), []
        times = np.sort(np.concatenate([b["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64) for b in batches]))
        for t in times[np.concatenate([[True], times[1:] != times[:-1]])].tolist():
            if last is not None and t > last + silent_ms:
                out.append(("gone", last + silent_ms))
            if last is None or t > last + silent_ms:
                out.append(("here", t))
            last = t if last is None else max(last, t)
        if last + silent_ms <= state.getCurrentWatermarkMs():
            out.append(("gone", last + silent_ms))
            if state.exists:
                state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(last + silent_ms)
        yield told(key[0], out)

    seen = positions.select("peer", "ts").withWatermark("ts", late)
    return seen.groupBy("peer").applyInPandasWithState(step, PRESENCE_OUT, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def link_profile(samples: DataFrame) -> DataFrame:
    """Profile of each link after each sample; state is the last four samples and the automaton's state number."""
    coded = samples.select("link", "seq", "rtt_ms")
    limits = [5.0, 50.0]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, at = (list(state.get[0]), state.get[1]) if state.exists else ([], START)
        rows = pd.concat(batches).sort_values("seq")
        out = []
        for v in rows["rtt_ms"]:
            recent = (recent + [float(v)])[-5:]
            median = sorted(recent)[len(recent) // 2]
            cand = sum(median >= x for x in limits)
            at = int(TRANSITION[at, cand])
            out.append(PROFILES[at // UPGRADE_AFTER])
        state.update((recent, at))
        yield pd.DataFrame({"link": rows["link"], "seq": rows["seq"], "profile": out})

    return coded.groupBy("link").applyInPandasWithState(
        step, "link bigint, seq bigint, profile string", "recent array<double>, at int", "append", GroupStateTimeout.NoTimeout
    )


def region_change(positions: DataFrame) -> DataFrame:
    """Rows where a peer enters another region cell; the last cell is the state.  Needs peer, seq, lat, lon."""
    r = region_id("lat", "lon", 3)
    cells = positions.select("peer", "seq", r["x"].alias("x"), r["y"].alias("y"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(batches).sort_values("seq")
        kept = []
        for i, (x, y) in enumerate(zip(rows["x"], rows["y"])):
            if last != (x, y):
                last = (x, y)
                kept.append(i)
        state.update((int(last[0]), int(last[1])))
        yield rows.iloc[kept]

    out = "peer bigint, seq bigint, x bigint, y bigint"
    return cells.groupBy("peer").applyInPandasWithState(step, out, "x bigint, y bigint", "append", GroupStateTimeout.NoTimeout)


def fanout(events: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Deliver a stream of events to subscribers of its regions; the subscriber table is static."""
    from ..functions.geo import region_topic, subscribe_topics

    topics = subscribers.select("subscriber", F.explode(subscribe_topics(region_id("lat", "lon", 3))).alias("topic"))
    return events.withColumn("topic", region_topic(region_id("lat", "lon", 3))).join(topics, "topic")


def content_feed(items: DataFrame, keep: int = 200, name: str = "content") -> DataFrame:
    """Newest items per section whose id matches their fields, each once.

    ``items``: id, section, title, body, author, created_at.  The table never holds more than ``keep`` per section.
    """
    fields = ["section", "title", "body", "author"]

    def merge(table, batch):
        good = batch.where(F.col("id") == dr.content_id(*fields, "created_at"))
        rows = good if table is None else table.drop("rank").unionByName(good)
        return dr.section_top_n(rows.dropDuplicates(["id"]), keep)

    return run_upserts(items, name, merge, ["section"])


def key_feed(events: DataFrame, name: str = "keys") -> DataFrame:
    """Key table from a stream of records and revocations: newest record per peer, revocations stick.

    ``events``: kind ('record' or 'revoke'), peer, seq, updated_at, key_type, by, reason.  A record older than the one
    held is ignored; a revocation by the key itself or an authority becomes a tombstone.  Revocations are kept beside
    the records and judged against the newest ones, so one that comes before its record, or before the record that
    makes its sender an authority, waits for it, and the result does not depend on how the input is cut into batches.
    """
    columns = ["kind", "peer", "updated_at", "seq", "key_type", "by", "reason"]

    def merge(table, batch):
        rows = batch.select(*columns) if table is None else table.unionByName(batch.select(*columns))
        latest = dr.latest_key_record(rows.where("kind = 'record'")).select(*columns)
        # Of one sender's revocations of a key the first is enough.
        first = rows.where("kind = 'revoke'").groupBy("peer", "by").agg(F.min_by(F.struct("kind", "updated_at", "seq", "key_type", "reason"), "seq").alias("_r")).select("peer", "by", "_r.*")
        return latest.unionByName(first)

    table = run_upserts(events, name, merge, ["peer"])
    records = table.where("kind = 'record'").select("peer", "updated_at", "seq", "key_type", F.lit(False).alias("revoked"))
    sent = table.where("kind = 'revoke'").select(F.col("peer").alias("target"), "by", F.col("seq").alias("at"), "reason")
    return dr.revoke_keys(records, sent).select("peer", "updated_at", "seq", "key_type", "revoked")


def pull_feed(rows: DataFrame, key: str, order: list[str], name: str = "pull") -> DataFrame:
    """Incremental pull as a stream: each run takes what arrived and keeps the newest row per key."""

    def merge(table, batch):
        return dr.latest_key_record(batch if table is None else table.unionByName(batch), key, order)

    return run_upserts(rows, name, merge, [key])
