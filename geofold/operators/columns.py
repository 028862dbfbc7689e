"""Voxel columns as run-length rows ``(chunk, vx, vz, y0, y1, material)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import CHUNK_X, CHUNK_Y, CHUNK_Z, big, chunk_of, col, column_gps, geoid_undulation
from .raster import column_slope

COLUMN = ["cx", "cz", "vx", "vz"]
BEDROCK_DEPTH = 200
RUN = "array<struct<y0:bigint,y1:bigint,material:string>>"


def chunk_columns(chunks: DataFrame, origin_y) -> DataFrame:
    """The 30 x 30 columns of chunks ``cx, cz`` with their position on the ellipsoid."""
    out = (
        chunks.select("cx", "cz").distinct()
        .withColumn("vx", F.explode(F.sequence(F.col("cx") * CHUNK_X, F.col("cx") * CHUNK_X + CHUNK_X - 1)))
        .withColumn("vz", F.explode(F.sequence(F.col("cz") * CHUNK_Z, F.col("cz") * CHUNK_Z + CHUNK_Z - 1)))
        .withColumn("_g", column_gps("vx", "vz", origin_y))
    )
    return out.select(*COLUMN, F.col("_g.lat").alias("lat"), F.col("_g.lon").alias("lon"))


def terrain_columns(columns: DataFrame, origin_alt: float, origin_vy: int) -> DataFrame:
    """Surface, slope, class and materials of columns.

    ``columns``: cx, cz, vx, vz, lat, lon, z (sampled height, null when unknown), and optionally ground_level,
    ground_strength, landuse, ocean, twi, tri, slope_raster, coast_m, reservoir_m.
    """
    have = set(columns.columns)
    z = F.coalesce("z", F.lit(origin_alt))
    if "ground_level" in have:
        z = rules.engineered_height(z, "ground_level", "ground_strength")
    delta = z + geoid_undulation("lat", "lon") - origin_alt
    out = columns.withColumn("z", z).withColumn("_d", delta)
    out = out.withColumn("surface_y", big(F.col("_d")) + origin_vy).withColumn("surface_y_f", F.col("_d") + origin_vy).drop("_d")
    # Classes come before the window, which keeps later filters from unfolding their rules, and after the shuffle to chunks that
    # both of its directions need: with the heights in one step they make a method too long for the JVM to compile.
    out = out.withColumn("climate", rules.climate_zone("lat", "z")).repartition("cx", "cz")
    out = rules.classify_column(out, slope="slope_raster" if "slope_raster" in have else "_none")
    out = column_slope(out, ["cx", "cz"])
    m = rules.surface_materials("biome", "substrate", "soil_depth", "slope_deg")
    return out.withColumn("_m", m).select("*", "_m.surface", "_m.subsurface", "_m.soil").drop("_m")


def layer_of(y0, y1) -> Column:
    """Chunk layers a run spans."""
    return F.sequence(chunk_of(y0, CHUNK_Y), chunk_of(y1, CHUNK_Y))


def by_layer(runs: DataFrame) -> DataFrame:
    """Cut runs at chunk layers; adds ``cy``."""
    out = runs.withColumn("cy", F.explode(layer_of("y0", "y1")))
    lo = F.col("cy") * CHUNK_Y
    return out.withColumn("y0", F.greatest("y0", lo)).withColumn("y1", F.least(F.col("y1"), lo + CHUNK_Y - 1))


def column_runs(columns: DataFrame) -> DataFrame:
    """Bedrock, soil, surface and reservoir water of terrain columns, as runs."""
    s, soil = F.col("surface_y"), F.col("soil")

    def run(y0, y1, material):
        return F.struct(big(y0).alias("y0"), big(y1).alias("y1"), material.alias("material"))

    flooded = F.lit(False)
    runs = [
        run(s - BEDROCK_DEPTH, s - soil - 1, F.lit("STONE")),
        run(s - soil, s - 1, F.col("subsurface")),
    ]
    if "reservoir_m" in columns.columns:
        level = F.col("reservoir_m")
        flooded = F.coalesce(level > F.col("z"), F.lit(False))
        top = s + F.ceil(level - F.col("z"))
        runs.append(F.when(flooded, run(s + 1, top, F.lit("WATER"))))
    runs.append(run(s, s, F.when(flooded, F.lit("WATER")).otherwise(F.col("surface"))))
    out = columns.select(*COLUMN, F.explode(F.array(*runs)).alias("_r")).where(F.col("_r").isNotNull())
    return out.select(*COLUMN, "_r.*").where(F.col("y1") >= F.col("y0"))


def paint(layers: DataFrame, keys: Sequence[str] = COLUMN) -> DataFrame:
    """Flatten overlapping runs: at each height the run with the highest ``ord`` shows; AIR clears.

    A column has few runs (its height is bounded), so each is flattened by itself.  Adjacent equal runs merge.
    """
    keys = list(keys)
    items = layers.groupBy(*keys).agg(F.collect_list(F.struct("ord", "y0", "y1", "material")).alias("_i"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("_i", lambda r: r["y0"]), F.transform("_i", lambda r: r["y1"] + 1))))
    items = items.withColumn("_c", cuts)
    spans = F.zip_with(
        F.slice("_c", F.lit(1), F.size("_c") - 1), F.slice("_c", F.lit(2), F.size("_c") - 1),
        lambda a, b: F.struct(a.alias("y0"), (b - 1).alias("y1")),
    )

    def shown(s):
        over = F.filter("_i", lambda r: (r["y0"] <= s["y0"]) & (r["y1"] >= s["y1"]))
        return F.struct(s["y0"].alias("y0"), s["y1"].alias("y1"), F.array_max(over)["material"].alias("material"))

    flat = F.filter(F.transform(spans, shown), lambda r: r["material"].isNotNull() & (r["material"] != "AIR"))

    def merge(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((last["material"] == r["material"]) & (last["y1"] + 1 == r["y0"]), F.lit(False))
        grown = F.struct(last["y0"].alias("y0"), r["y1"].alias("y1"), r["material"].alias("material"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(r)))

    items = items.withColumn("_f", flat)
    merged = F.aggregate("_f", F.array().cast(RUN), merge)
    return items.select(*keys, F.explode(merged).alias("_r")).select(*keys, "_r.*")


def overlay(runs: DataFrame, changes: DataFrame, keys: Sequence[str] = COLUMN) -> DataFrame:
    """Runs with changes ``keys, y0, y1, material, ord`` (ord from 1) painted over them; untouched columns pass by."""
    keys = list(keys)
    touched = changes.select(*keys).distinct()
    rest = runs.join(touched, keys, "left_anti").select(*keys, "y0", "y1", "material")
    base = runs.join(touched, keys, "left_semi").select(*keys, "y0", "y1", "material", F.lit(0).alias("ord"))
    done = paint(base.unionByName(changes.select(*keys, "y0", "y1", "material", F.col("ord").cast("int").alias("ord"))), keys)
    return rest.unionByName(done)


def voxel_edits_apply(runs: DataFrame, winners: DataFrame) -> DataFrame:
    """Winning edits ``vx, vy, vz, material`` over generated runs."""
    edits = winners.select(
        chunk_of("vx", CHUNK_X).alias("cx"), chunk_of("vz", CHUNK_Z).alias("cz"), "vx", "vz",
        F.col("vy").alias("y0"), F.col("vy").alias("y1"), "material", F.lit(1).alias("ord"),
    )
    return overlay(runs, edits)


def vegetation(columns: DataFrame) -> DataFrame:
    """Trunk and crown runs of the trees on terrain columns, kept inside their chunk; they fill air only.

    Each column rolls against its biome's density with a hash of its place.  A crown is a set of vertical runs
    around the trunk, one per offset; the outer shell of sparse crowns is thinned voxel by voxel.
    """
    v = rules.VEGETATION

    def attr(i, cast):
        return rules.lookup("biome", v, None, lambda x: x[i]).cast(cast)

    h = F.xxhash64("vx", "vz")
    t = columns.where((F.col("slope_deg") <= 32.0) & (F.col("surface") != "WATER")).withColumn("_density", attr(0, "double"))
    t = t.where(F.col("_density").isNotNull() & (F.pmod(h, F.lit(65536)) / 65536.0 <= F.col("_density")))
    lo, hi = attr(1, "bigint"), attr(2, "bigint")
    trunk = lo + F.pmod(F.shiftright(h, 16), F.greatest(hi - lo, F.lit(1)))
    t = t.select(*COLUMN, "surface_y", trunk.alias("trunk"), attr(3, "bigint").alias("cr"), attr(4, "string").alias("shape"), h.alias("seed"))
    base, cr, shape = F.col("surface_y") + F.col("trunk"), F.col("cr"), F.col("shape")
    trunks = t.where("trunk > 0").select(*COLUMN, (F.col("surface_y") + 1).alias("y0"), base.alias("y1"), F.lit("WOOD").alias("material"))

    span = F.sequence(-cr, cr)
    c = t.withColumn("dx", F.explode(span)).withColumn("dz", F.explode(span))
    d2, half = F.col("dx") * F.col("dx") + F.col("dz") * F.col("dz"), big(F.floor(cr / 2))
    c = c.where(d2 <= cr * cr).withColumn("_reach", big(F.floor(F.sqrt((cr * cr - d2).cast("double")))))
    cone = shape == "Cone"
    low = F.when(cone, F.lit(0)).otherwise(F.greatest(half - F.col("_reach"), -half))
    high = (
        F.when(cone, F.least(cr - F.greatest(big(F.ceil(F.sqrt(d2.cast("double")))), F.lit(1)), cr + 1))
        .when(shape == "Shrub", F.least(half + F.col("_reach"), half + 1))
        .otherwise(F.least(half + F.col("_reach"), cr + 1))
    )
    c = c.withColumn("_lo", low).withColumn("_hi", high).where(F.col("_hi") >= F.col("_lo"))
    solid = c.where(shape != "Sparse").select(*COLUMN, "dx", "dz", (base + F.col("_lo")).alias("y0"), (base + F.col("_hi")).alias("y1"))
    thin = c.where(shape == "Sparse").withColumn("dy", F.explode(F.sequence("_lo", "_hi")))
    inner = d2 + (F.col("dy") - half) * (F.col("dy") - half) <= (cr - 1) * (cr - 1)
    roll = F.xxhash64(F.col("vx") + F.col("dx") * 7 + F.col("dy"), F.col("vz") + F.col("dz") * 5 + F.col("dy"))
    thin = thin.where(inner | (F.pmod(roll.bitwiseXOR(F.col("seed")), F.lit(4)) != 0))
    thin = thin.select(*COLUMN, "dx", "dz", (base + F.col("dy")).alias("y0"), (base + F.col("dy")).alias("y1"))
    leaves = solid.unionByName(thin).select(
        "cx", "cz", (F.col("vx") + F.col("dx")).alias("vx"), (F.col("vz") + F.col("dz")).alias("vz"), "y0", "y1", F.lit("LEAVES").alias("material")
    )
    inside = leaves.where((chunk_of("vx", CHUNK_X) == F.col("cx")) & (chunk_of("vz", CHUNK_Z) == F.col("cz")))
    return trunks.unionByName(inside)


def with_vegetation(runs: DataFrame, trees: DataFrame) -> DataFrame:
    """Trees under the ground in rank, so they fill air only; wood shows before leaves."""
    ranked = trees.withColumn("ord", F.when(F.col("material") == "WOOD", -1).otherwise(-2))
    touched = trees.select(*COLUMN).distinct()
    base = runs.join(touched, COLUMN, "left_semi").withColumn("ord", F.lit(0))
    rest = runs.join(touched, COLUMN, "left_anti").select(*COLUMN, "y0", "y1", "material")
    return rest.unionByName(paint(base.select(*COLUMN, "y0", "y1", "material", "ord").unionByName(ranked.select(*COLUMN, "y0", "y1", "material", "ord"))))
