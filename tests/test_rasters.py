import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geofold.operators import ground, raster
from geofold.operators.spatial_join import Grid, explode_segments, rasterize_lines


def grid_df(spark, z, region="A"):
    rows = [(region, r, c, float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "region string, r bigint, c bigint, z double")


@pytest.mark.parametrize("block", [4, 7, 64])
def test_flow_accumulation_matches_sequential(spark, block):
    z = np.random.default_rng(block).random((19, 23)).cumsum(axis=0)
    out = raster.terrain(grid_df(spark, z), 0.001)
    acc = {(r["r"], r["c"]): r["acc"] for r in raster.flow_accumulation(out.select("region", "r", "c", "dir"), block=block).collect()}
    dirs = {(r["r"], r["c"]): r["dir"] for r in out.collect()}
    want = {k: 1 for k in dirs}
    for r, c in sorted(dirs, key=lambda k: -z[k]):
        d = dirs[(r, c)]
        if d < 8:
            want[(r + raster.D8[d][0], c + raster.D8[d][1])] += want[(r, c)]
    assert acc == want


def test_coast_distance_is_manhattan_and_capped(spark):
    z = np.zeros((13, 17))
    coast = {(2, 3), (11, 15), (7, 0)}
    df = grid_df(spark, z).withColumn("coast", F.concat_ws("_", "r", "c").isin(*[f"{a}_{b}" for a, b in coast]))
    step = 0.1
    got = {(r["r"], r["c"]): r["coast_m"] for r in raster.coast_distance(df, step).collect()}
    for (r, c), v in got.items():
        k = min(abs(r - a) + abs(c - b) for a, b in coast)
        assert v == pytest.approx(k * 11132.0 if (k - 1) * 11132.0 < 50000 else 50000.0)


def test_slope_of_a_plane_and_rim_over_blocks(spark):
    z = np.add.outer(np.arange(12) * 2.0, np.arange(10) * 1.0)
    near = raster.neighbours(grid_df(spark, z), block=5)
    out = raster.with_slope_aspect(near, 1 / raster.M_PER_DEG).where("r between 1 and 10 and c between 1 and 8").collect()
    for row in out:
        assert row["slope_deg"] == pytest.approx(np.degrees(np.arctan(np.sqrt(5.0))))


def test_ragged_neighbours_match_brute_force(spark):
    rnd = random.Random(3)
    cells = {(r, c): rnd.random() for r in range(14) for c in range(11) if rnd.random() < 0.6}
    df = spark.createDataFrame([("A", r, c, z) for (r, c), z in cells.items()], "region string, r bigint, c bigint, z double")
    for row in raster.neighbours(df, block=4).collect():
        for name, (dr, dc) in zip(raster.D8_NAMES, raster.D8):
            assert row[f"z_{name}"] == cells.get((row["r"] + dr, row["c"] + dc))


def test_digital_line_matches_error_loop(spark):
    rnd = random.Random(5)
    ends = [(rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(60)]
    rows = [(i, [{"lat": float(a), "lon": float(b)}, {"lat": float(c), "lon": float(d)}]) for i, (a, b, c, d) in enumerate(ends)]
    lines = spark.createDataFrame(rows, "line_id bigint, line array<struct<lat:double,lon:double>>")
    got = {}
    for r in rasterize_lines(explode_segments(lines), Grid(0.0, 0.0, 1.0, 31, 31)).collect():
        got.setdefault(r["line_id"], set()).add((r["r"], r["c"]))
    for i, (r, c, r1, c1) in enumerate(ends):
        dc, dr = abs(c1 - c), abs(r1 - r)
        err, want = dc - dr, {(r, c)}
        while (r, c) != (r1, c1):
            e2 = 2 * err
            if e2 > -dr:
                err -= dr
                c += 1 if c < c1 else -1
            if e2 < dc:
                err += dc
                r += 1 if r < r1 else -1
            want.add((r, c))
        assert got[i] == want


def box(lat0, lat1, lon0, lon1):
    return [{"lat": a, "lon": b} for a, b in ((lat0, lon0), (lat0, lon1), (lat1, lon1), (lat1, lon0), (lat0, lon0))]


AREA = "poly_id bigint, seq bigint, area_type string, polygon array<struct<lat:double,lon:double>>"


def test_engineered_ground_shares_the_lowest_bench(spark):
    g = Grid(0.0, 0.0, 1.0, 12, 12)
    heights = spark.createDataFrame([(r, c, 10.0 + c) for r in range(12) for c in range(12)], "r bigint, c bigint, z double")
    areas = spark.createDataFrame(
        [(1, 1, "pitch", box(2.1, 4.9, 2.1, 4.9)), (2, 2, "pitch", box(2.1, 4.9, 4.5, 7.9)), (3, 3, "park", box(8.2, 9.8, 8.2, 9.8))], AREA
    )
    out = {(r["r"], r["c"]): (r["level_m"], r["strength"]) for r in ground.engineered_ground(areas, heights, g).collect()}
    assert {v[0] for v in out.values()} == {12.0}
    assert (3, 3) in out and (3, 6) in out
    assert not any(r >= 7 for r, _ in out)  # the park meets no seed


def test_support_area_joins_a_seed_and_halo_respects_height(spark):
    g = Grid(0.0, 0.0, 1.0, 14, 14)
    for slope, wide in ((0.1, True), (30.0, False)):
        heights = spark.createDataFrame([(r, c, slope * c) for r in range(14) for c in range(14)], "r bigint, c bigint, z double")
        areas = spark.createDataFrame([(1, 1, "recreation_ground", box(5.1, 7.9, 5.1, 7.9))], AREA)
        out = {(r["r"], r["c"]): r["strength"] for r in ground.engineered_ground(areas, heights, g).collect()}
        assert out[(6, 6)] == 1.0 and out[(5, 5)] == 0.85
        assert ((6, 9) in out) == wide
    grown = spark.createDataFrame(
        [(1, 1, "pitch", box(5.1, 6.9, 5.1, 6.9)), (2, 2, "park", box(4.1, 8.9, 4.1, 8.9))], AREA
    )
    flat = spark.createDataFrame([(r, c, 0.5 * c) for r in range(14) for c in range(14)], "r bigint, c bigint, z double")
    out = {(r["r"], r["c"]): r["strength"] for r in ground.engineered_ground(grown, flat, g).collect()}
    assert out[(8, 8)] == 0.75 and out[(7, 5)] in (0.9, 1.0)
