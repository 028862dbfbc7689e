from pyspark.sql import functions as F

from geofold.functions import rules
from geofold.operators import columns as co, roads as rd
from geofold.plans import region_bake as rb
from geofold.plans.bake import ORIGIN


def test_crossing_reads_water_beyond_its_chunk(spark, monkeypatch):
    """A road beside a chunk's side, with stored water on one side of it and map water across the border on the other."""
    around = co.chunk_columns(spark.createDataFrame([(44599, 113400), (44600, 113400)], "cx bigint, cz bigint"), F.lit(ORIGIN.ecef_y)).cache()
    at = {(r["vx"], r["vz"]): r.asDict() for r in around.collect()}
    columns, x0, z0 = around.where("cx = 44600"), 44600 * 30, 113400 * 30
    cls = F.lit("Primary")
    half = spark.range(1).select(F.ceil(rules.road_width_m(cls) / 2 + rules.footpath_width_m(cls)).alias("h")).first()["h"]
    place = lambda x, z: {k: at[x, z][k] for k in ("lat", "lon")}
    line = [place(x0 + half - 2, z0 + 3), place(x0 + half - 2, z0 + 26)]
    roads = spark.createDataFrame([(1, "Primary", line, False, False, 0)], "road_id bigint, cls string, line array<struct<lat: double, lon: double>>, is_bridge boolean, is_tunnel boolean, layer int")
    ring = [place(x, z) for x, z in ((x0 - 20, z0), (x0 - 1, z0), (x0 - 1, z0 + 29), (x0 - 20, z0 + 29))]
    water = spark.createDataFrame([(1, ring, [])], "poly_id bigint, polygon array<struct<lat: double, lon: double>>, holes array<array<struct<lat: double, lon: double>>>")
    run = lambda y0, y1, m: columns.select(*co.COLUMN, F.lit(y0).cast("bigint").alias("y0"), F.lit(y1).cast("bigint").alias("y1"), F.lit(m).alias("material"))
    runs = run(0, 49, "STONE").unionByName(run(50, 54, "WATER").where(F.col("vx") > x0 + 2 * half))
    monkeypatch.setattr(rd, "road_grade", lambda near, *_: near.withColumn("road_y", F.lit(60).cast("bigint")))
    lines = spark.createDataFrame([(1, "river", [place(x0 - 8, z0), place(x0 - 8, z0 + 29)])], "line_id bigint, waterway string, line array<struct<lat: double, lon: double>>")
    found, real = [], rd.road_crossing_mode
    monkeypatch.setattr(rd, "road_crossing_mode", lambda *a: found.append((a, real(*a))) or found[-1][1])
    rb.road_pass(runs, columns, roads, water, lines.where("false"), None, ORIGIN)
    rb.road_pass(runs, columns, roads, water.where("false"), lines, None, ORIGIN)
    for _, mode in found:
        assert {r["mode"] for r in mode.collect()} == {"culvert"}
    args = found[0][0]
    assert real(*args[:3], args[3].where("false")).count() == 0
