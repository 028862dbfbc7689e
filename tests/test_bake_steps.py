import re

from pyspark.sql import functions as F

from geofold.operators import columns as co, hydrology as hy
from geofold.plans import region_bake as rb


def _columns(spark):
    at = spark.range(900).select(F.floor(F.col("id") / 30).alias("vx"), (F.col("id") % 30).alias("vz"))
    place = at.select(F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cz"), "vx", "vz", (F.col("vz") * 0.0008 - 27.5).alias("lat"), (F.col("vx") * 0.0008 + 153.0).alias("lon"))
    x, y = F.col("vx"), F.col("vz")
    return place.select("*", (x * y % 50 * 0.5).alias("z"), (x % 9 * 2.0).alias("twi"), (y % 30 * 1.0).alias("tri"), (x % 40 * 1.0).alias("slope_raster"), (y * 100.0).alias("coast_m"),
                        F.when(x % 5 == 0, "Forest").alias("landuse"), F.when(y % 7 == 0, 9.0).alias("reservoir_m"))


def test_terrain_is_made_once_for_runs_and_trees(spark):
    columns = _columns(spark)
    out = rb.terrain_pass(columns, rb.Origin(20.0, 100, 0.0))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # every part of a tree made the columns anew
    terrain = co.terrain_columns(columns, 20.0, 100)
    want = co.with_vegetation(co.column_runs(terrain), co.vegetation(terrain)).select(*out.columns)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, want.collect())) and {r[-1] for r in got} >= {"WOOD", "LEAVES", "WATER"}


def test_steps_of_terrain_are_short_enough_to_compile(spark, capsys):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        co.terrain_columns(_columns(spark).withColumn("lat", F.col("lat") * 1.0), 20.0, 100).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # over 8,000 bytes the JVM interprets a method; it was one of over 10,000


def test_flat_water_is_found_once(spark):
    ring = "array(named_struct('lat', -27.51D, 'lon', 152.99D), named_struct('lat', -27.51D, 'lon', 153.01D), named_struct('lat', -27.49D, 'lon', 153.01D), named_struct('lat', -27.49D, 'lon', 152.99D))"
    water = spark.range(2).selectExpr("id poly_id", "if(id = 0, 'lake', 'river') water_type", f"{ring} polygon", f"slice(array({ring}), 1, 0) holes")
    lines = spark.range(1).selectExpr("id line_id", "'river' waterway", "array(named_struct('lat', -27.5D, 'lon', 153D), named_struct('lat', -27.499D, 'lon', 153.001D)) line")
    columns = _columns(spark).withColumn("terrain_y", F.col("z").cast("bigint"))
    out = hy.water_polygon_fill(columns, water, lines)
    inside = [r for r in columns.collect() if -27.51 < r["lat"] < -27.49 and 152.99 < r["lon"] < 153.01]
    level = max(min(r["terrain_y"] for r in inside), max(r["terrain_y"] for r in inside) - 15)
    assert {(r["vx"], r["vz"], r["level_y"]) for r in out.collect()} == {(r["vx"], r["vz"], level) for r in inside if r["terrain_y"] <= level + 15}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # each reader looked for the water anew
