import random

from pyspark.sql import functions as F

from geofold.operators import columns as co, hydrology as hy, roads as rd
from geofold.operators.chunks import affected_chunks


def test_affected_chunks_at_faces_edges_and_corners(spark):
    df = spark.createDataFrame([(15, 100, 15, 1), (30, 100, 15, 2), (30, 100, 30, 4), (30, 200, 30, 8)], "x bigint, y bigint, z bigint, n int")
    assert df.where(F.size(affected_chunks("x", "y", "z")) != F.col("n")).count() == 0


def test_paint_matches_voxel_by_voxel(spark):
    rnd = random.Random(1)
    rows = []
    for v in range(40):
        for k in range(rnd.randrange(1, 7)):
            y = rnd.randrange(0, 40)
            rows.append((0, 0, v, 0, y, y + rnd.randrange(0, 15), rnd.choice(["STONE", "WATER", "AIR", "GRASS"]), k))
    df = spark.createDataFrame(rows, "cx bigint, cz bigint, vx bigint, vz bigint, y0 bigint, y1 bigint, material string, ord int")
    got = {}
    for r in co.paint(df).collect():
        for y in range(r["y0"], r["y1"] + 1):
            assert (r["vx"], y) not in got
            got[(r["vx"], y)] = r["material"]
    want = {}
    for _, _, v, _, y0, y1, m, _ in sorted(rows, key=lambda r: r[7]):
        for y in range(y0, y1 + 1):
            want[(v, y)] = m
    assert got == {k: m for k, m in want.items() if m != "AIR"}


CHANNEL = "cx bigint, cz bigint, vx bigint, vz bigint, terrain_y bigint, water_y bigint, wetted bigint, half_width_m double, center_depth_m double, dist_m double, polygon_backed boolean, inside_polygon boolean, mask boolean"


def bridge_rows(wet, terrain=None):
    rows = []
    for x in range(12):
        for z in range(8):
            w = wet.get((x, z))
            t = (terrain or {}).get((x, z), 53)
            rows.append((0, 0, x, z, t, w, 2 if w is not None else None, 3.0 if w is not None else None, 2.0 if w is not None else None, 1.0 if w is not None else None, False if w is not None else None, False if w is not None else None, False))
    return rows


def test_channel_bridge_fills_short_gaps_only(spark):
    wet = {(1, 3): 50, (4, 3): 51, (10, 3): 50}
    out = hy.channel_bridge(spark.createDataFrame(bridge_rows(wet), CHANNEL)).where("bridged").collect()
    assert {(r["vx"], r["vz"]) for r in out} == {(2, 3), (3, 3)}
    assert all(r["wetted"] == 2 for r in out)
    steep = hy.channel_bridge(spark.createDataFrame(bridge_rows({(1, 3): 50, (4, 3): 60}), CHANNEL)).where("bridged")
    assert steep.count() == 0
    buried = hy.channel_bridge(spark.createDataFrame(bridge_rows(wet, {(2, 3): 70}), CHANNEL)).where("bridged").collect()
    assert {(r["vx"], r["vz"]) for r in buried} == {(3, 3)}


def test_wetting_and_taper_rules(spark):
    one = spark.range(1)
    row = one.select(
        hy.channel_wetting(F.lit(None).cast("bigint"), F.lit(True), F.lit(True), F.lit(True)).alias("inside"),
        hy.channel_wetting(F.lit(3).cast("bigint"), F.lit(True), F.lit(False), F.lit(False)).alias("outside"),
        hy.bank_taper(F.lit(60), F.lit(50), F.lit(3.0), F.lit(3.0), F.lit(2.0)).alias("edge"),
        hy.bank_taper(F.lit(60), F.lit(50), F.lit(9.0), F.lit(3.0), F.lit(2.0)).alias("far"),
    ).collect()[0]
    assert (row["inside"], row["outside"], row["edge"], row["far"]) == (1, None, 51, None)


ROAD = "cx bigint, cz bigint, vx bigint, vz bigint, road_y bigint, material string, is_bridge boolean, is_tunnel boolean, terrain_y bigint, terrain_material string, bridge_y bigint, culvert_floor bigint, culvert_top bigint, water_floor bigint"


def road_map(spark, **kw):
    base = dict(cx=0, cz=0, vx=1, vz=1, road_y=50, material="ASPHALT", is_bridge=False, is_tunnel=False, terrain_y=50, terrain_material="GRASS", bridge_y=None, culvert_floor=None, culvert_top=None, water_floor=None)
    base.update(kw)
    df = spark.createDataFrame([tuple(base.values())], ROAD)
    changes = rd.road_runs(df)
    ground = df.select("cx", "cz", "vx", "vz", F.lit(0).cast("bigint").alias("y0"), F.col("terrain_y").alias("y1"), F.lit("DIRT").alias("material"))
    out = {}
    for r in co.overlay(ground, changes).collect():
        for y in range(r["y0"], r["y1"] + 1):
            out[y] = r["material"]
    return out


def test_road_cut_fill_bridge_tunnel_and_culvert(spark):
    cut = road_map(spark, road_y=45)
    assert cut[45] == "ASPHALT" and cut[44] == "GRAVEL" and max(cut) == 45
    fill = road_map(spark, road_y=54)
    assert fill[54] == "ASPHALT" and [fill[y] for y in (51, 52, 53)] == ["GRAVEL"] * 3
    deck = road_map(spark, road_y=60, is_bridge=True)
    assert deck[60] == "ASPHALT" and deck[59] == deck[58] == "CONCRETE" and 57 not in deck and deck[50] == "DIRT"
    over = road_map(spark, road_y=50, terrain_material="WATER")
    assert over[54] == "ASPHALT"
    bore = road_map(spark, road_y=40, is_tunnel=True)
    assert bore[40] == "ASPHALT" and bore[39] == "STONE" and not any(y in bore for y in range(41, 46)) and bore[46] == "DIRT"
    under = road_map(spark, road_y=44, is_tunnel=True, water_floor=46)
    assert under[39] == "ASPHALT"
    culvert = road_map(spark, road_y=56, culvert_floor=51, culvert_top=53)
    assert [culvert.get(y) for y in (51, 52, 53, 54, 55, 56)] == ["WATER", "WATER", "WATER", None, "GRAVEL", "ASPHALT"]


def test_terrain_columns_at_whole_metres_equal_sql(spark, tmp_path):
    """Prices that put columns on a whole metre, where the last bit of the geoid decides on the voxel."""
    import duckdb

    from geofold.plans import catalog

    con = duckdb.connect()
    con.execute(f"""copy (select k o_orderkey, round(3000*(40+k % 17-(33.2-0.38*(k//125*0.0008-0.56)+0.14*(0.02+k % 125*0.0008))),2) o_totalprice
       from range(60000) r(k)) to '{tmp_path}/orders.parquet'""")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = catalog.queries()["terrain_columns"](spark, str(tmp_path)).select("vx", "vz", "surface_y", "surface_y_f").toPandas()
    want = con.execute(f"select vx, vz, surface_y, surface_y_f from ({catalog.oracle_sql()['terrain_columns']}) q").df()
    both = got.merge(want, on=["vx", "vz"], suffixes=("", "_w"))
    assert len(both) == len(want) == 60000
    assert (both["surface_y"] == both["surface_y_w"]).all() and (both["surface_y_f"] == both["surface_y_f_w"]).all()
