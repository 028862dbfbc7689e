"""Streams over shuffled files give what the batch gives."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from geofold.operators import motion, oplog
from geofold.streaming import jobs
from geofold.streaming.runner import parquet_stream, run_to_parquet

OPS = "op_id bigint, author bigint, lamport bigint, vx bigint, vy bigint, vz bigint, material string, ts timestamp"


def stream_of(spark, df, path, files):
    df.repartition(files).write.parquet(path)
    return parquet_stream(spark, path, files_per_trigger=1)


def test_lww_stream_equals_batch_with_duplicates(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, rnd.randrange(4), rnd.randrange(30), rnd.randrange(3), rnd.randrange(2), 0, rnd.choice("AB"), None) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:40], OPS)
    want = {tuple(r) for r in oplog.lww_register(df).collect()}
    got = jobs.stream_lww(stream_of(spark, df, str(tmp_path / "a"), 4))
    assert {tuple(r) for r in got.select("vx", "vy", "vz", "op_id", "author", "lamport", "material").collect()} == want


def test_delta_stream_equals_batch(spark, tmp_path):
    rows = [(p, i, i * 40 + (i // 50) * 700, (i % 5) * 0.03, 0.0, 0.0, 0.0, 0.0, "walk" if i % 90 < 45 else "fly") for p in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, jobs.POSITION_OUT)
    want = {(r["peer"], r["seq"]) for r in motion.delta_filter(df).collect()}
    last, kept = {}, set()
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        d = dict(zip(["peer", "seq", "ms", "x", "y", "z", "yaw", "pitch", "mode"], r))
        if motion.needs_send(last.get(r[0]), d):
            last[r[0]] = d
            kept.add((r[0], r[1]))
    assert want == kept
    # Files split by time, so the state carries over from one to the next.
    path = str(tmp_path / "p")
    for i in range(4):
        df.where(F.floor(F.col("seq") / 50) == i).coalesce(1).write.mode("append").parquet(path)
    got = run_to_parquet(jobs.position_delta(parquet_stream(spark, path, files_per_trigger=1)), "t")
    assert {(r["peer"], r["seq"]) for r in got.collect()} == want


def test_key_feed_keeps_tombstones_and_ignores_stale(spark, tmp_path):
    schema = "kind string, peer bigint, seq bigint, updated_at bigint, key_type string, `by` bigint, reason string"
    path = str(tmp_path / "k")
    batches = [
        [("record", 1, 1, 10, "User", None, None), ("record", 2, 2, 10, "Admin", None, None)],
        [("revoke", 1, 3, 0, None, 2, "abuse"), ("revoke", 2, 4, 0, None, 1, "spite")],
        [("record", 1, 5, 30, "User", None, None), ("record", 2, 6, 5, "Guest", None, None)],
    ]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    out = {r["peer"]: (r["key_type"], r["revoked"]) for r in jobs.key_feed(parquet_stream(spark, path, files_per_trigger=1)).collect()}
    assert out == {1: ("User", True), 2: ("Admin", False)}


def test_key_feed_waits_for_the_record_of_a_revocation(spark, tmp_path):
    schema = "kind string, peer bigint, seq bigint, updated_at bigint, key_type string, `by` bigint, reason string"
    rows = [("revoke", 1, 1, 0, None, 2, "abuse"), ("record", 1, 2, 10, "User", None, None), ("record", 2, 3, 10, "Admin", None, None), ("revoke", 3, 4, 0, None, 3, "lost"), ("record", 3, 5, 5, "User", None, None)]
    for name, cut in (("one", [rows]), ("each", [[r] for r in rows]), ("back", [[r] for r in rows[::-1]])):
        path = str(tmp_path / name)
        for b in cut:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        out = jobs.key_feed(parquet_stream(spark, path, files_per_trigger=1))
        assert {r["peer"]: r["revoked"] for r in out.collect()} == {1: True, 2: False, 3: True}


def test_stream_ops_takes_late_ops_and_checks_the_key(spark, tmp_path):
    from datetime import datetime, timedelta

    keys = spark.createDataFrame([(1, "Admin", None, False, True), (2, "Admin", None, False, False)], "peer bigint, key_type string, expires_at double, revoked boolean, self_sig_ok boolean")
    start, path = datetime(2024, 1, 1), str(tmp_path / "o")
    rows = [(1, 1, start + timedelta(days=2)), (2, 1, start), (3, 2, start + timedelta(days=3)), (1, 1, start + timedelta(days=2)), (4, 1, start + timedelta(hours=1))]
    for i, a, ts in rows:
        spark.createDataFrame([(i, a, "SetVoxel", True, ts)], "op_id bigint, author bigint, action string, sig_ok boolean, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    ok = jobs.stream_ops(parquet_stream(spark, path, files_per_trigger=1), keys, F.lit(0.0))
    assert sorted(r["op_id"] for r in run_to_parquet(ok.select("op_id", "author"), "ops").collect()) == [1, 2, 4]


def test_smoothing_does_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(p, i, i * 60 + rnd.randrange(50), rnd.random(), rnd.random(), 0.0, 1.0, 2.0, 0.0) for p in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "peer bigint, lamport bigint, ms bigint, x double, y double, z double, vx double, vy double, vz double")
    want = sorted(tuple(round(v, 9) for v in r) for r in motion.position_smooth(df).collect())
    path = str(tmp_path / "s")
    for lo, hi in ((0, 3), (3, 25), (25, 40)):
        df.where((F.col("lamport") >= lo) & (F.col("lamport") < hi)).coalesce(1).write.mode("append").parquet(path)
    got = run_to_parquet(jobs.position_smooth(parquet_stream(spark, path, files_per_trigger=1)), "smooth")
    assert sorted(tuple(round(v, 9) for v in r) for r in got.collect()) == want


def test_upserts_rewrite_touched_buckets_alone(spark, tmp_path):
    """Batches of few keys leave the other buckets' files; emptied buckets and replays come out right."""
    import os

    from geofold.streaming.runner import run_upserts

    path = str(tmp_path / "u")
    for i in range(6):  # files in the order of their time: many keys, then one key a batch, then a removal
        rows = [(k, 0) for k in range(200)] if i == 0 else [(7, -1 if i == 5 else i)]
        spark.createDataFrame(rows, "k bigint, v int").coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not os.path.exists(f"{path}/{f}.seen"):
                os.utime(f"{path}/{f}", (1_000_000 + i * 60, 1_000_000 + i * 60))
                open(f"{path}/{f}.seen", "w").close()
    read, written = [], []

    def merge(table, batch):
        read.append(0 if table is None else table.count())
        both = batch if table is None else table.unionByName(batch)
        best = both.groupBy("k").agg(F.max("v").alias("v"), F.min("v").alias("low")).where("low >= 0 or k <> 7").select("k", "v")
        written.append(best.count())
        return best

    out = run_upserts(parquet_stream(spark, path, files_per_trigger=1), "u", merge, ["k"], buckets=50)
    got = {r["k"]: r["v"] for r in out.collect()}
    assert got == {k: 0 for k in range(200) if k != 7}
    assert written[0] == 200 and read[0] == 0 and max(read[1:]) < 20 and max(written[1:]) < 20 and len(read) == 6


def test_presence_timers(spark, tmp_path):
    """A silent peer is told gone by the others' time; a late row moves nothing; a peer that comes back is told again."""
    import os

    path = str(tmp_path / "p")
    batches = [[(1, 0), (2, 0)], [(2, 4)], [(2, 3), (2, 9), (3, 9)], [(3, 60)], [(1, 61), (3, 100)], [(3, 200)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "peer bigint, s bigint").select("peer", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not os.path.exists(f"{path}/{f}.seen"):
                os.utime(f"{path}/{f}", (1_000_000 + i * 60, 1_000_000 + i * 60))
                open(f"{path}/{f}.seen", "w").close()
    out = run_to_parquet(jobs.presence_events(parquet_stream(spark, path, files_per_trigger=1), 5_000, "1 second"), "presence")
    got = sorted((r["peer"], r["s"], r["event"]) for r in out.select("peer", "event", (F.unix_millis("at") / 1000 - 1_700_000_000).cast("int").alias("s")).collect())
    assert [x for x in got if x[0] == 1] == [(1, 0, "here"), (1, 5, "gone"), (1, 61, "here"), (1, 66, "gone")]
    assert [x for x in got if x[0] == 2] == [(2, 0, "here"), (2, 14, "gone")]
    assert [x for x in got if x[0] == 3] == [(3, 9, "here"), (3, 14, "gone"), (3, 60, "here"), (3, 65, "gone"), (3, 100, "here"), (3, 105, "gone"), (3, 200, "here")]


def test_stream_of_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(str(tmp_path / "many.parquet"))
    part = next((tmp_path / "many.parquet").glob("part-*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    got = {f: run_to_parquet(parquet_stream(spark, str(tmp_path), f"{f}.parquet"), f).count() for f in ("many", "one")}
    assert got == {"many": 10, "one": spark.read.parquet(str(part)).count()}


def test_rows_of_a_hot_key_come_in_parts():
    """A key with many rows is put in order without a Python object a row; positions were all turned into dicts before."""
    import tracemalloc

    n = 200_000
    rnd = np.random.default_rng(3)
    seq = rnd.permutation(n)
    df = pd.DataFrame({"seq": seq, "x": seq / 2, "mode": np.where(seq % 2 == 0, "walk", "fly")})
    tracemalloc.start()
    got, low = [], 0
    for part in jobs.in_order((df.iloc[i : i + 10_000] for i in range(0, n, 10_000)), ["seq", "x", "mode"], "seq"):
        rows = part.to_dict("records")
        assert len(rows) <= 10_000 and rows[0]["seq"] == low and rows[0]["mode"] == ("walk" if low % 2 == 0 else "fly")
        low += len(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert low == n and peak < 40 * n
