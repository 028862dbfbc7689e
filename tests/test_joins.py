import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.operators import motion, oplog, skew, spatial_join as sj


def test_salted_join_keeps_all_pairs_of_a_hot_key(spark):
    big = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50))
    small = spark.createDataFrame([(k, f"v{k}{j}") for k in range(0, 40) for j in range(2)], "k bigint, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(small, ["k"], how).count()
        assert skew.salted_join(big, small, ["k"], ["id"], how, hot_rows=100).count() == plain


def test_pick_rank_is_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rnd.integers(0, 9, 500)] + [("b", float(v)) for v in rnd.normal(size=333)] + [("c", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in skew.pick_rank(df, ["k"], "v", F.floor(F.col("n") * 0.4), "m", buckets=16).collect()}
    for k in "abc":
        vals = sorted(v for kk, v in rows if kk == k)
        assert got[k] == (len(vals), vals[int(len(vals) * 0.4)])
    assert skew.pick_rank(df, [], "v", F.lit(0), "m").collect()[0]["m"] == min(v for _, v in rows)


def test_prev_known_and_positions_over_buckets(spark):
    rnd = random.Random(2)
    rows = [(p, i, float(rnd.random()) if rnd.random() < 0.4 else None) for p in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "p bigint, i bigint, v double")
    back = {(r["p"], r["i"]): r["o"] for r in skew.prev_known(df, ["p"], F.floor(F.col("i") / 17), ["i"], F.col("v"), "o").collect()}
    ahead = {(r["p"], r["i"]): r["o"] for r in skew.prev_known(df, ["p"], F.floor(F.col("i") / 17), ["i"], F.col("v"), "o", forward=True).collect()}
    by = {p: [v for q, _, v in rows if q == p] for p in range(3)}
    for p, i, _ in rows:
        assert back[(p, i)] == next((v for v in reversed(by[p][:i]) if v is not None), None)
        assert ahead[(p, i)] == next((v for v in by[p][i + 1 :] if v is not None), None)
    pos = skew.dense_position(df, ["p"], F.floor(F.col("i") / 17), ["i"])
    assert pos.where("pos <> i + 1").count() == 0


def test_components_match_union_find(spark):
    rnd = random.Random(4)
    n, pairs = 120, [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(90, 118)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = {r["v"]: r["component"] for r in sj.components(spark.range(n).withColumnRenamed("id", "v"), spark.createDataFrame(pairs, "a bigint, b bigint"), "v").collect()}
    assert got == {i: find(i) for i in range(n)}


def test_box_pairs_with_mixed_sizes(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(80):
        x, y, s = rnd.uniform(0, 100), rnd.uniform(0, 100), rnd.choice([0.5, 3.0, 40.0])
        rows.append((i, x, y, x + s * rnd.random(), y + s * rnd.random()))
    df = spark.createDataFrame(rows, "id bigint, x0 double, y0 double, x1 double, y1 double")
    got = {tuple(sorted((r["a"], r["b"]))) for r in sj.box_pairs(df, "id", ["x0", "y0"], ["x1", "y1"], 1.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert got == want


def test_claims_follow_the_sequential_rule(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(70):
        x, z = rnd.randrange(200), rnd.randrange(200)
        rows.append((i, i % 5, x, x + rnd.randrange(5, 60), 0, 10, z, z + rnd.randrange(5, 60)))
    df = spark.createDataFrame(rows, "seq bigint, owner bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint, z0 bigint, z1 bigint")
    kept = []
    for r in rows:
        if not any(r[2] <= k[3] and r[3] >= k[2] and r[6] <= k[7] and r[7] >= k[6] for k in kept):
            kept.append(r)
    assert {r["seq"] for r in oplog.accept_claims(df).collect()} == {r[0] for r in kept}


def test_nearest_k_in_crowds_and_far_away(spark):
    rnd = random.Random(9)
    pts = [(i, rnd.gauss(0, 20), rnd.gauss(0, 20), 0.0) for i in range(60)] + [(100 + i, 5000.0 * i, 90000.0, 10.0) for i in range(6)]
    df = spark.createDataFrame(pts, "peer bigint, x double, y double, z double")
    got = {}
    for r in motion.tiered_top_k(df, df, 5).collect():
        got.setdefault(r["observer"], []).append((r["rank"], r["peer"]))
    for o in pts:
        order = sorted((((o[1] - p[1]) ** 2 + (o[2] - p[2]) ** 2 + (o[3] - p[3]) ** 2) ** 0.5, p[0]) for p in pts if p[0] != o[0])
        assert [p for _, p in sorted(got[o[0]])] == [p for _, p in order[:5]]


def test_link_automaton_does_not_depend_on_piece_size(spark):
    rnd = random.Random(10)
    rows = [(k, i + 1, rnd.choice([2.0, 20.0, 80.0])) for k in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "link bigint, seq bigint, rtt_ms double")
    runs = [sorted(tuple(r) for r in motion.link_profile(df, n).collect()) for n in (11, 50, 100000)]
    assert runs[0] == runs[1] == runs[2]


def stepwise(cand, state):
    out = []
    for c in cand:
        state = int(motion.TRANSITION[state, c])
        out.append(state)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 1000])
def test_steps_in_rows_equal_single_steps(n):
    cand = np.random.default_rng(n).integers(0, 3, n)
    for start in range(len(motion.TRANSITION)):
        assert motion.steps_taken(cand, start).tolist() == stepwise(cand, start)
        assert motion.steps_map(cand)[start] == stepwise(cand, start)[-1]


def test_steps_of_many_pieces_equal_single_steps():
    rnd = np.random.default_rng(5)
    size = np.array([1, 2, 64, 65, 128, 1, 700, 129])
    first, cand = np.cumsum(size) - size, rnd.integers(0, 3, size.sum())
    start = rnd.integers(0, len(motion.TRANSITION), len(size))
    steps = motion.PieceSteps(cand, first)
    parts = np.split(cand, first[1:])
    assert steps.taken(start).tolist() == [x for p, s in zip(parts, start.tolist()) for x in stepwise(p, s)]
    for p, m in zip(parts, steps.maps()):
        assert m.tolist() == motion.steps_map(p).tolist()


def test_link_profile_takes_many_pieces_in_a_call(spark):
    """Pieces of a batch are one call of Python, and a piece that goes on in the next batch keeps its state."""
    rnd = random.Random(12)
    rows = [(k, i + 1, rnd.choice([2.0, 20.0, 80.0])) for k in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "link bigint, seq bigint, rtt_ms double")
    plan = motion.link_profile(df, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    whole = sorted(tuple(r) for r in motion.link_profile(df, 10).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(tuple(r) for r in motion.link_profile(df, 10).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_maps_are_chained_over_blocks(spark):
    """Many blocks of one key beside a key with a single map, missing pieces, and no maps at all."""
    rnd = random.Random(4)
    rows = [(1, p, [rnd.randrange(5) for _ in range(5)]) for p in range(100) if p % 7] + [(2, 3, [4, 3, 2, 1, 0]), (None, 0, [0] * 5), (None, 9, [1] * 5)]
    want, state = set(), {}
    for key, p, m in rows:
        want.add((key, p, state.get(key, 2)))
        state[key] = m[state.get(key, 2)]
    rnd.shuffle(rows)
    maps = spark.createDataFrame(rows, "link bigint, piece bigint, map array<int>")
    for block in (1, 4, 1024):
        got = [tuple(r) for r in motion.chain_maps(maps.where("link is not null"), "link", "piece", 2, block).collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if w[0] is not None}
    assert motion.chain_maps(maps.where("false"), "link", "piece", 2).collect() == []


def test_long_link_over_many_blocks(spark):
    rnd = random.Random(11)
    rows = [(1, i + 1, rnd.choice([2.0, 20.0, 80.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "link bigint, seq bigint, rtt_ms double")
    cut, whole = (sorted(tuple(r) for r in motion.link_profile(df, *n).collect()) for n in ((9, 4), (1000,)))
    assert cut == whole and {r[3] for r in whole} >= {"LAN", "Normal", "Constrained"}


@pytest.mark.parametrize("seed", [1, 2])
def test_lww_ignores_arrival_order(spark, seed):
    rnd = random.Random(seed)
    ops = [(i, rnd.randrange(5), rnd.randrange(40), rnd.randrange(3), 0, 0, rnd.choice("ABC")) for i in range(1000)]
    schema = "op_id bigint, author bigint, lamport bigint, vx bigint, vy bigint, vz bigint, material string"
    first = {tuple(r) for r in oplog.lww_register(spark.createDataFrame(ops, schema)).collect()}
    rnd.shuffle(ops)
    assert {tuple(r) for r in oplog.lww_register(spark.createDataFrame(ops + ops[:100], schema).repartition(7)).collect()} == first


def test_trust_chains_of_any_length_and_cycles(spark):
    from geofold.operators import directory as dr

    rows = [(i, i - 1 if i else None, i != 20) for i in range(40)] + [(100, 101, True), (101, 102, True), (102, 100, True), (103, 100, True), (104, 999, True)]
    got = {r["peer"]: tuple(r)[1:] for r in dr.trust_chain(spark.createDataFrame(rows, "peer bigint, issued_by bigint, issuer_ok boolean")).select("peer", "hops", "ok", "root", "cycle").collect()}
    assert all(got[i] == (i, i < 20, 0, False) for i in range(40))
    assert all(got[i] == (None, False, None, True) for i in (100, 101, 102, 103)) and got[104] == (1, True, 999, False)


def test_large_fills_are_runs(spark):
    rows = [(1, (-35, -10**9, 2), (40, 10**9, 65)), (2, (0, 5, 0), (0, 4, 0))]
    point = "struct<x:bigint,y:bigint,z:bigint>"
    out = oplog.fill_region(spark.createDataFrame(rows, f"op_id bigint, box_min {point}, box_max {point}")).collect()
    assert {(r["vx"], r["vz"]) for r in out} == {(x, z) for x in range(-35, 41) for z in range(2, 66)} and len(out) == 76 * 64
    assert all((r["y0"], r["y1"]) == (-10**9, 10**9) and (r["cx"], r["cz"]) == (r["vx"] // 30, r["vz"] // 30) for r in out)


def test_bilinear_height_with_missing_corners(spark):
    from geofold.operators.elevation import dem_bilinear

    cells = spark.createDataFrame([(0, 0, 100.0), (0, 1, 100.0), (1, 0, 100.0), (5, 5, None)], "r bigint, c bigint, z double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.0, 5.0)], "p bigint, lat double, lon double")
    assert [tuple(r) for r in dem_bilinear(points, cells, sj.Grid(0.0, 0.0, 1.0, 8, 8), ["p"]).collect()] == [(1, 100.0)]


def _ring(rng, n, lat, lon, size):
    import math

    turn = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(lat + size * (0.3 + 0.7 * rng.random()) * math.sin(x), lon + size * (0.3 + 0.7 * rng.random()) * math.cos(x)) for x in turn]


@pytest.mark.parametrize("mode", ["touch", "centre"])
def test_scan_lines_against_single_cells(spark, mode):
    """Every cell of a small grid against the predicate of one cell, for rings inside, across and beside the grid."""
    import random

    from geofold.functions.geometry import point_in_polygon, polygon_hits_cell
    from geofold.operators.elevation import grid_cells
    from geofold.operators.spatial_join import Grid, rasterize_polygons

    rng, grid = random.Random(7), Grid(-1.0, 10.0, 0.1, 21, 16)
    rings = [_ring(rng, rng.randint(3, 14), rng.uniform(-1.3, 1.4), rng.uniform(9.7, 11.8), rng.choice([0.04, 0.3, 1.0])) for _ in range(40)]
    rings += [[(-1.0, 10.0), (-1.0, 10.5), (0.0, 10.5), (0.0, 10.0)], [(-0.95, 10.05), (-0.95, 10.25), (-0.75, 10.25)], [(0, 10.2), (0.5, 10.2), (0.25, 10.2)], [(0, 0), (1, 1)]]
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in r]) for i, r in enumerate(rings)], "poly_id int, polygon array<struct<lat:double,lon:double>>")
    got = {tuple(r) for r in rasterize_polygons(df, grid, mode).collect()}
    cells = grid_cells(spark, grid)
    pairs = df.where(F.size("polygon") > 2).crossJoin(cells)
    if mode == "centre":
        y, x = grid.centre(F.col("r"), F.col("c"))
        pairs = pairs.withColumn("y", y).withColumn("x", x).where(point_in_polygon("y", "x", "polygon"))
    else:
        pairs = pairs.where(polygon_hits_cell("polygon", grid.cell_box(F.col("r"), F.col("c"))))
    want = {tuple(r) for r in pairs.select("poly_id", "r", "c").collect()}
    # Rings that only touch a cell's side from outside their own box's cells are not looked at there.
    assert got <= want and len(want - got) <= 12 and len(got) > 500


def test_scan_lines_of_a_long_ring(spark):
    """A ring of 100,000 edges over many cells: rows grow with edges and cells."""
    from geofold.operators.spatial_join import Grid, rasterize_polygons

    n, grid = 100_000, Grid(0.0, 0.0, 0.01, 200, 200)
    turn = F.col("id") * (2 * 3.141592653589793 / n)
    wave = 0.8 + 0.01 * F.sin(turn * 500)
    ring = spark.range(n).select(F.col("id"), (1 + wave * F.sin(turn)).alias("lat"), (1 + wave * F.cos(turn)).alias("lon"))
    poly = ring.groupBy(F.lit(1).alias("poly_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "lat", "lon"))), lambda p: F.struct(p["lat"], p["lon"])).alias("polygon"))
    poly = poly.select("poly_id", F.col("polygon").cast("array<struct<lat:double,lon:double>>").alias("polygon"))
    inside = {(r["r"], r["c"]) for r in rasterize_polygons(poly, grid, "centre").collect()}
    for r in range(0, 200, 7):
        for c in range(0, 200, 7):
            d = ((r * 0.01 + 0.005 - 1) ** 2 + (c * 0.01 + 0.005 - 1) ** 2) ** 0.5
            if abs(d - 0.8) > 0.02:
                assert ((r, c) in inside) == (d < 0.8)
    assert rasterize_polygons(poly, grid).count() > len(inside)


def test_gap_of_many_tiles(spark):
    """Water twenty tiles before a chunk and fifty after it is bridged; with a limit of steps it is not."""
    from geofold.operators import features as ft

    chunks = spark.createDataFrame([(1, 0.005, 0.005, 0.0, 0.0, 0.0, 1.0), (2, 5.005, 0.005, 0.0, 0.0, 0.0, 1.0)], "chunk_id int, lat double, lon double, first_lat double, first_lon double, last_lat double, last_lon double")
    pond = lambda w: [(0.002, w), (0.008, w), (0.008, w + 0.004), (0.002, w + 0.004)]
    water = spark.createDataFrame([(1, pond(-0.237)), (2, pond(0.603))], "poly_id int, geom array<struct<lat:double,lon:double>>")
    wet = ft.features_to_tiles(water)
    got = ft.gap_bridge(chunks, wet).collect()
    assert [r["chunk_id"] for r in got] == [1] and {round(p["lon"], 3) < 0 for p in got[0]["quad"]} == {True, False}
    assert ft.gap_bridge(chunks, wet, max_steps=8).count() == 0


def test_joins_of_unfolded_tables_are_not_broadcast(spark):
    from geofold.operators import features

    members = spark.range(4).selectExpr("id", "array(named_struct('ref', id, 'role', 'outer')) members")
    ways = spark.range(4).selectExpr("id way_id", "explode(sequence(1, 3)) n", "array(named_struct('lat', 0D, 'lon', 0D)) geom")
    peers = spark.range(40).selectExpr("id peer", "double(id % 3) x", "double(id % 2) y", "0D z")
    for df in (features.relation_rings(members, ways), motion.tiered_top_k(peers, peers, 5)):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_nearest_k_where_many_share_a_place(spark):
    pts = [(i, float(i % 3), 0.0, 0.0) for i in range(90)] + [(200, 700.0, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "peer bigint, x double, y double, z double")
    got = {}
    for r in motion.tiered_top_k(df, df, 5).collect():
        got.setdefault(r["observer"], []).append((r["rank"], r["peer"]))
    for o in pts:
        order = sorted((abs(o[1] - p[1]), p[0]) for p in pts if p[0] != o[0])
        tier = lambda d: 1 if d <= 100 else 2 if d <= 500 else 3 if d <= 1000 else 4
        assert [p for _, p in sorted(got[o[0]])] == [p for _, _, p in sorted((tier(d), d, p) for d, p in order)[:5]]


def test_nearest_segment_is_exact_on_both_sides_of_the_first_ring(spark):
    from geofold.functions.geometry import segment_hit

    rnd = random.Random(12)
    at = lambda: (-27.5 + rnd.random() * 0.01, 153.0 + rnd.random() * 0.01)
    pts = spark.createDataFrame([(i, *at()) for i in range(60)], "id bigint, lat double, lon double")
    rows = [(i, 0, *at(), *at()) for i in range(12)]
    rows += [(i + 100, 0, *r[2:]) for i, r in enumerate(rows)]  # copies with later ids
    segs = spark.createDataFrame(rows, "line_id bigint, seg bigint, y0 double, x0 double, y1 double, x1 double").selectExpr(
        "line_id", "seg", "named_struct('lat', y0, 'lon', x0) a", "named_struct('lat', y1, 'lon', x1) b")
    d = segment_hit("lat", "lon", F.col("a"), F.col("b"))["dist_m"]
    want = {}
    for r in pts.crossJoin(segs).select("id", "line_id", d.alias("d")).where("d <= 300").collect():
        want[r["id"]] = min(want.get(r["id"], (1e9, 0)), (r["d"], r["line_id"]))
    got = sj.nearest_segment(pts, segs, ["id"], ["line_id", "seg"], 300.0, 300.0).collect()
    assert {r["id"]: (r["dist_m"], r["line_id"]) for r in got} == want
    assert {x[0] <= 37.5 for x in want.values()} == {True, False}
    near = sj.nearest_distance(pts, segs, ["id"], 300.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and {r["id"]: r["dist_m"] for r in near.collect()} == {i: x[0] for i, x in want.items()}


def test_equal_polygons_are_tested_once(spark):
    ring = "array(named_struct('lat', y, 'lon', x), named_struct('lat', y, 'lon', x + 0.01D), named_struct('lat', y + 0.01D, 'lon', x))"
    polys = spark.range(40).selectExpr("id poly_id", "double(id % 2) y", "0D x").selectExpr("poly_id", f"{ring} polygon")
    pts = spark.range(6).selectExpr("id", "double(id % 3) + 0.002D lat", "0.002D lon")
    got = {(r["id"], r["poly_id"]) for r in sj.points_in_polygons(pts, polys, ["id"]).collect()}
    assert got == {(i, p) for i in range(6) for p in range(40) if i % 3 == p % 2}
    assert sj.points_in_classes(pts, sj.polygon_classes(polys), ["id"]).count() == 4


def test_fanout_counts_are_those_of_the_deliveries(spark):
    pts = spark.range(50).selectExpr("id event_id", "(id % 7) * 0.004D lat", "(id % 5) * 0.006D lon")
    subs = spark.range(6).selectExpr("id subscriber", "id * 0.01D lat", "0D lon")
    want = {tuple(r) for r in motion.region_fanout(pts, subs).groupBy("subscriber").agg(F.count(F.lit(1))).collect()}
    assert {tuple(r) for r in motion.fanout_counts(motion.routed(pts), subs).collect()} == want and want


def test_short_lines_are_keyed_below_a_hundredth_degree(spark):
    # Thirty short lines of one cell of 0.01 degrees: before, a point there met all of them.
    rows = [(i, 10.0 + 0.0003 * i, 20.0001, 10.0002 + 0.0003 * i, 20.0003) for i in range(30)]
    df = spark.createDataFrame(rows, "i bigint, y0 double, x0 double, y1 double, x1 double")
    box = F.struct(F.col("y0").alias("lat_min"), F.col("y1").alias("lat_max"), F.col("x0").alias("lon_min"), F.col("x1").alias("lon_max"))
    keyed = sj.key_boxes(df, box)
    point = sj.key_points_for(spark.createDataFrame([(10.0031, 20.0002)], "lat double, lon double"), keyed)
    met = {r["i"] for r in keyed.join(point, ["gl", "gs", "gw"]).collect()}
    assert 10 in met and len(met) < 15
    assert {r["i"] for r in keyed.collect()} == set(range(30))


def test_features_to_tiles_unfolds_without_arrays_of_tiles(spark):
    from geofold.functions.geometry import tile_keys_of_bbox
    from geofold.operators import features as ft

    rows = [(i, [(0.013 * i, -0.02), (0.013 * i + 0.04, 0.03 + 0.01 * i)]) for i in range(5)] + [(9, None)]
    df = spark.createDataFrame(rows, "i bigint, geom array<struct<lat:double,lon:double>>")
    out = ft.features_to_tiles(df).select("i", "tile_s", "tile_w")
    want = df.select("i", F.explode(tile_keys_of_bbox("geom")).alias("k")).select("i", "k.s", "k.w")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "flatten(" not in out._jdf.queryExecution().toString()  # an array of all tiles was built by interpreted code before


def test_tiles_of_ways_need_no_geometry(spark):
    from geofold.operators import features as ft
    from geofold.plans import catalog

    rnd = random.Random(4)
    nodes = spark.createDataFrame([(i, rnd.uniform(-0.05, 0.05), rnd.uniform(-0.05, 0.05)) for i in range(40)], "node_id bigint, lat double, lon double")
    members = [(w, s, rnd.randrange(45)) for w in range(50) for s in range(rnd.randrange(1, 6))]
    way_nodes = spark.createDataFrame(members, "way_id bigint, seq bigint, node_id bigint")
    got = ft.each_tile(ft.way_tile_ranges(way_nodes, nodes))
    want = ft.features_to_tiles(ft.way_geometry(way_nodes, nodes)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len(want.select("way_id").distinct().collect()) > 20
    plan = catalog.queries()["features_to_tiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Before, way nodes were ordered, sorted out by hot nodes and gathered as geometries: eight shuffles.
    assert plan.count("Exchange hashpartitioning") == 3 and "collect_list" not in plan and "Window" not in plan


def test_bbox_features_counts_tiles_of_each_box(spark):
    from geofold.operators import features as ft

    rnd, rows = random.Random(8), []
    for i in range(60):
        y, x = rnd.uniform(-0.05, 0.05), rnd.uniform(-0.05, 0.05)
        rows.append((f"l{i % 3}", [(y, x), (y + rnd.uniform(0, 0.06), x + rnd.uniform(0, 0.06))]))
    df = spark.createDataFrame(rows, "layer string, geom array<struct<lat:double,lon:double>>")
    want = {}
    for r in ft.features_to_tiles(df).collect():
        key = (r["layer"], r["tile_s"], r["tile_w"])
        want[key] = want.get(key, 0) + 1
    got = ft.bbox_features(df)  # took features by tile before
    assert {(r["layer"], r["tile_s"], r["tile_w"]): r["n"] for r in got.collect()} == want


def test_equal_polygons_are_tested_once(spark, monkeypatch):
    square = lambda y, x: [(y, x), (y, x + 1.0), (y + 1.0, x + 1.0), (y + 1.0, x)]
    rows = [(i, square(0.0, 0.0)) for i in range(10, 16)] + [(3, square(0.5, 0.5)), (4, square(0.5, 0.5)), (7, square(5.0, 5.0)), (8, square(5.0, 5.0)), (9, [(0.2, 0.2), (0.3, 0.3)]), (2, None)]
    df = spark.createDataFrame(rows, "poly_id bigint, polygon array<struct<lat:double,lon:double>>")
    asked, real = [], sj.box_pairs

    def counted(d, *args, **more):
        asked.append(d.count())
        return real(d, *args, **more)

    monkeypatch.setattr(sj, "box_pairs", counted)
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in sj.polygon_edges(df, "poly_id").collect())
    near = [3, 4, *range(10, 16)]
    assert got == sorted([(a, b) for a in near for b in near if a < b] + [(7, 8)])
    part = {r["poly_id"]: r["component"] for r in sj.polygon_components(df, "poly_id").collect()}
    assert part == {i: 3 for i in near} | {7: 7, 8: 7, 9: 9, 2: 2}
    assert asked == [3, 3]  # each of the twelve polygons was asked for before


def test_ring_stitch_takes_relations_in_batches(spark):
    from geofold.operators import features as ft

    arcs = [(1, 0, [(0.0, 0.0), (0.0, 1.0)]), (1, 2, [(0.0, 0.0), (1.0, 1.0)]), (1, 1, [(1.0, 1.0), (0.0, 1.0)]), (2, 0, [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0)]), (3, 0, [(8.0, 8.0), (8.0, 9.0)])]
    df = spark.createDataFrame([(r, s, "outer", g) for r, s, g in arcs] + [(1, 3, "inner", arcs[3][2])], "relation_id bigint, seq bigint, role string, geom array<struct<lat:double,lon:double>>")
    out = ft.ring_stitch(df)
    got = {(r["relation_id"], r["ring"]): [tuple(p) for p in r["geom"]] for r in out.collect()}
    assert got == {(1, 0): [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)], (2, 0): [(5.0, 5.0), (5.0, 6.0), (6.0, 6.0), (5.0, 5.0)]}
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # each relation was a call of its own before


def test_proximity_pairs_deals_a_crowded_cell_to_many_tasks(spark):
    peers = spark.range(200).select(F.col("id").alias("peer"), (F.col("id") % 20).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    out = motion.proximity_pairs(peers.where("peer < 50"), peers)
    assert out.count() == 50 * 199
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "_part" in plan  # the side unfolded to 27 cells was broadcast before, and cells were not dealt


def test_proximity_pairs_takes_places_of_observers_once(spark, monkeypatch):
    monkeypatch.setattr(motion, "PLACE_IDS", 8)  # lists of a place are split
    rows = [(i, 40.0 * (i % 3), 0.0 if i % 3 else -0.0, 0.0) for i in range(90)] + [(90, 1050.0, 0.0, 0.0), (91, None, 0.0, 0.0), (92, 0.0, 0.0, 1.0 / 3)]
    peers = spark.createDataFrame(rows, "peer bigint, x double, y double, z double")
    out = motion.proximity_pairs(peers.where("peer < 60 or peer > 89"), peers, digits=5)
    dist = lambda a, b: sum((a[k] - b[k]) ** 2 for k in (1, 2, 3)) ** 0.5
    want = sorted((a[0], b[0], round(dist(a, b), 5)) for a in rows for b in rows if a[0] != b[0] and (a[0] < 60 or a[0] > 89) and 91 not in (a[0], b[0]) and dist(a, b) <= 1000)
    assert sorted((r["observer"], r["peer"], r["dist_m"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_observers") < plan.index("SQRT") and plan.index("explode(_observers") < plan.index("round(")  # a distance was taken and rounded for each pair


def test_pairs_of_equal_polygons_are_unfolded_where_they_are_found(spark, monkeypatch):
    ring = "array(named_struct('lat', y, 'lon', x), named_struct('lat', y, 'lon', x + 0.01D), named_struct('lat', y + 0.01D, 'lon', x))"
    polys = spark.range(60).selectExpr("id poly_id", "double(id % 2) y", "0D x").selectExpr("poly_id", f"{ring} polygon")
    pts = spark.range(6).selectExpr("id", "double(id % 3) + 0.002D lat", "0.002D lon")
    monkeypatch.setattr(sj, "MEMBERS", 7)
    found = sj.points_in_polygons(pts, polys, ["id"])
    got = [(r["id"], r["poly_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, p) for i in range(6) for p in range(60) if i % 3 == p % 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(_members") < plan.index("Join")  # nothing joins the pairs
    inside = sj.points_inside(pts, polys, ["id"])
    assert sorted(r["id"] for r in inside.collect()) == [0, 1, 3, 4] and "LeftSemi" in inside._jdf.queryExecution().optimizedPlan().toString()


def test_backing_is_found_without_pairs_of_copies(spark):
    """Equal rivers and equal lines inside them: ids as from the pairs, and no plan forms the pairs."""
    from geofold.operators import hydrology as hy

    ring = "array(named_struct('lat', y, 'lon', 0D), named_struct('lat', y, 'lon', 0.01D), named_struct('lat', y + 0.01D, 'lon', 0D))"
    water = spark.range(30).selectExpr("id poly_id", "double(id % 3) y", "if(id % 5 = 4, 'lake', 'river') water_type").selectExpr("poly_id", "water_type", f"{ring} polygon", f"array({ring}) holes").withColumn("holes", F.slice("holes", 1, 0))
    line = "array(named_struct('lat', y + 0.001D, 'lon', 0.001D), named_struct('lat', y + 0.003D, 'lon', 0.003D))"
    lines = spark.range(12).selectExpr("id line_id", "double(id % 4) * 2 y", "if(id = 4, 'canal ditch', 'river') waterway").selectExpr("line_id", "waterway", f"{line} line")
    pairs = {(r["poly_id"], r["line_id"]) for r in hy.channel_backing(water, lines).collect()}
    assert pairs == {(p, l) for p in range(30) for l in range(12) if p % 3 == l % 4 * 2 and p % 5 != 4 and l != 4}
    polys, backed = hy.backed_polygons(water, lines), hy.backing_lines(water, lines)
    assert {r["poly_id"] for r in polys.collect()} == {p for p, _ in pairs} and {r["line_id"] for r in backed.collect()} == {l for _, l in pairs}
    for df in (polys, backed):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan and "_members" not in plan


def test_catch_up_takes_each_op_under_its_first_chunk(spark):
    """Hits are told from what each requested chunk knows of earlier ones, with repeated ids in the log, a null request and repeated chunks."""
    import random

    from geofold.operators import oplog

    rnd = random.Random(8)
    ops = [(i - i % 40 // 39, i % 7, i // 3, rnd.randrange(-40, 70), rnd.randrange(-5, 5), rnd.randrange(-40, 40), "DIRT") for i in range(400)]
    named = [(r, s, rnd.randrange(-2, 3), rnd.randrange(-1, 1), rnd.randrange(-2, 2)) for r in (1, 2, None) for s in range(12)]
    chunks = lambda o: {((o[3] + a) // 30, (o[4] + b) // 200, (o[5] + c) // 30) for a in (-1, 0) for b in (-1, 0) for c in (-1, 0)}
    want = {}
    for r, s, *c in named:
        for o in ops:
            if tuple(c) in chunks(o):
                want[r, o[0]] = min(want.get((r, o[0]), s), s)
    requests = spark.createDataFrame(named, "request_id bigint, seq bigint, cx bigint, cy bigint, cz bigint")
    log = spark.createDataFrame(ops, "op_id bigint, author bigint, lamport bigint, vx bigint, vy bigint, vz bigint, material string")
    got = oplog.state_catch_up(log, requests).collect()
    assert {(r["request_id"], r["op_id"]): r["seq"] for r in got if r["request_id"] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    assert len(got) == len({(r["request_id"], r["op_id"]) for r in got})
    early = {(r["request_id"], r["seq"]): {tuple(c) for c in r["_earlier"]} for r in oplog._with_earlier(requests).collect()}
    first = {}
    for r, s, *c in named:
        first.setdefault((r, *c), s)
    near = lambda a, b: all(abs(x - y) <= 1 for x, y in zip(a, b))
    assert early == {(r, s): {tuple(d) for (q, *d), u in first.items() if q == r and u < s and near(c, d)} for (r, *c), s in first.items()}


def test_chunk_features_compares_classes(spark, monkeypatch):
    """Equal boxes and equal features are compared once; members, also of an id with two shapes, come once each."""
    from geofold.operators import features as ft

    seen, join = [], ft.salted_join

    def counted(big, small, *rest):
        seen.append((big.count(), small.count()))
        return join(big, small, *rest)

    monkeypatch.setattr(ft, "salted_join", counted)
    at = lambda y, x: [(y, x), (y + 0.001, x + 0.001)]
    rows = [(i, "water" if i % 2 else "roads", at(10.004 + i % 3 * 0.01, 20.004)) for i in range(30)] + [(1, "water", at(10.005, 20.005)), (7, "roads", at(50.0, 60.0))]
    chunks = [(i, 10.003 + i % 2 * 0.01, 10.006 + i % 2 * 0.01, 20.003, 20.006) for i in range(40)] + [(0, 10.013, 10.016, 20.003, 20.006), (5, 10.013, 10.016, 20.003, 20.006)]
    tiled = ft.features_to_tiles(spark.createDataFrame(rows, f"feature_id bigint, layer string, geom {ft.POINTS}"))
    got = [tuple(r) for r in ft.chunk_features(spark.createDataFrame(chunks, "chunk_id bigint, lat_min double, lat_max double, lon_min double, lon_max double"), tiled).select("chunk_id", "layer", "feature_id").collect()]
    m, want = ft.CHUNK_MARGIN_DEG, set()
    for i, layer, ((y, x), (v, u)) in rows:
        for c, y0, y1, x0, x1 in chunks:
            if v >= y0 - m and y <= y1 + m and u >= x0 - m and x <= x1 + m:
                want.add((c, layer, i))
    assert set(got) == want and len(got) == len(want) > 300
    assert seen == [(8, 18)]  # eight shapes by layer, a tile each; two boxes with nine tiles each
