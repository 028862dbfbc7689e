"""The whole bake of a region, from elevation to manifest: rasters of the region, then passes that are stored chunk by chunk.

elevation -> datum offset -> slope, flow, ruggedness, coast, land use, reservoirs, engineered ground -> columns -> terrain and
trees -> water -> roads -> edits -> objects on the ground.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.geo import big
from ..operators import aggregates as ag, columns as co, elevation as el, ground, hydrology as hy, inference, raster, roads as rd
from ..operators.columns import COLUMN
from ..operators.spatial_join import Grid, explode_segments, nearest_segment, points_inside, rasterize_lines
from ..session import cut_lineage
from ..sources import sinks
from ..sources.pass_store import PassStore

#: Half the width of the widest waterway line.
WIDEST_M = 12.0


@dataclass(frozen=True)
class Origin:
    """Reference point of the voxel grid."""

    alt: float
    vy: int
    ecef_y: float


@dataclass(frozen=True)
class Sources:
    """Tables a bake reads.

    ``sample(points, ids)`` gives heights ``ids, z`` of points ``lat, lon``.  ``columns``: the voxel columns of all chunks with
    ``lat, lon``; ``place(lat, lon)`` is the column ``(vx, vz)`` of a point.  Others may be None: ``areas`` (poly_id, seq,
    area_type, polygon), ``aeroways`` (the same with ``line``), ``coast`` (shore lines), ``water``, ``rivers``, ``lines``,
    ``roads``, ``edits`` (winning voxel edits) and ``objects`` (object_id, kind, lat, lon).
    """

    sample: Callable
    columns: DataFrame
    place: Callable[[Column, Column], tuple[Column, Column]]
    areas: DataFrame | None = None
    aeroways: DataFrame | None = None
    coast: DataFrame | None = None
    water: DataFrame | None = None
    rivers: DataFrame | None = None
    lines: DataFrame | None = None
    roads: DataFrame | None = None
    edits: DataFrame | None = None
    objects: DataFrame | None = None


def region_cells(spark, sample, grid: Grid) -> DataFrame:
    """Heights at the grid's nodes, corrected by the region's datum offset; nodes without a height are 0 before that."""
    cells = cut_lineage(el.sample_grid(spark, grid, sample))
    extent = [F.lit(v).alias(n) for n, v in (("lat_min", grid.lat_min), ("lat_max", grid.lat_max), ("lon_min", grid.lon_min), ("lon_max", grid.lon_max))]
    shift = el.datum_offset(cells.select("*", *extent)).select("region", "offset_m")
    # One row a region.
    return cells.join(shift, "region", "left").withColumn("z", F.col("z") + F.coalesce("offset_m", F.lit(0.0))).select("region", "r", "c", "lat", "lon", "z")


def raster_pass(spark, sources: Sources, grid: Grid) -> DataFrame:
    """Every cell of the region's grid with its height and what the rasters say of it."""
    cells = cut_lineage(region_cells(spark, sources.sample, grid))
    shape = cut_lineage(raster.terrain(cells, grid.step).select("region", "r", "c", "slope_deg", "tri", "dir"))
    flow = raster.flow_accumulation(shape.select("region", "r", "c", "dir"))
    keys = ["region", "r", "c"]
    out = cells.join(shape.join(flow, keys).select(*keys, F.col("slope_deg").alias("slope_raster"), "tri", raster.twi("acc", "slope_deg").alias("twi")), keys)
    if sources.coast is not None:
        segs = explode_segments(sources.coast)
        shore = rasterize_lines(segs, grid).select("r", "c").distinct().withColumn("coast", F.lit(True))
        marked = cells.join(shore, ["r", "c"], "left").withColumn("coast", F.coalesce("coast", F.lit(False)))
        out = out.join(raster.coast_distance(marked, grid.step, segments=segs).select(*keys, "coast_m"), keys)
    heights = cells.select("r", "c", "z")
    if sources.areas is not None:
        out = out.join(ground.landuse_raster(sources.areas, grid), ["r", "c"], "left")
        flat = ground.engineered_ground(sources.areas, heights, grid, sources.aeroways)
        out = out.join(flat.select("r", "c", F.col("level_m").alias("ground_level"), F.col("strength").alias("ground_strength")), ["r", "c"], "left")
    if sources.water is not None:
        out = out.join(ground.reservoir_surface(sources.water, heights, grid).withColumnRenamed("level_m", "reservoir_m"), ["r", "c"], "left")
    return out


def sampled_columns(columns: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Columns with the height between their four cells and the rasters of the nearest one."""
    z = el.dem_bilinear(columns, cells, grid, COLUMN)
    near = [big(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round((F.col(c) - low) / grid.step)))) for c, low, n in (("lat", grid.lat_min, grid.rows), ("lon", grid.lon_min, grid.cols))]
    placed = columns.select(*COLUMN, "lat", "lon", near[0].alias("r"), near[1].alias("c"))
    return placed.join(cells.drop("region", "lat", "lon", "z"), ["r", "c"], "left").drop("r", "c").join(z, COLUMN, "left")


def terrain_pass(columns: DataFrame, origin: Origin, trees: bool = True) -> DataFrame:
    """Runs of sampled columns, with trees in the gaps.

    Runs and every part of a tree read the columns again, so these are stored; what is not read is left behind.
    """
    terrain = co.terrain_columns(columns, origin.alt, origin.vy)
    if not trees:
        return co.column_runs(terrain)
    more = [c for c in ("reservoir_m",) if c in terrain.columns]
    terrain = cut_lineage(terrain.select(*COLUMN, "z", "surface_y", "surface", "subsurface", "soil", "slope_deg", "biome", *more))
    return co.with_vegetation(co.column_runs(terrain), cut_lineage(co.vegetation(terrain)))


def surfaces(runs: DataFrame) -> DataFrame:
    """Highest voxel and material per column."""
    top = runs.groupBy(*COLUMN).agg(F.max_by(F.struct("y1", "material"), "y1").alias("_t"))
    return top.select(*COLUMN, F.col("_t.y1").alias("terrain_y"), F.col("_t.material").alias("terrain_material"))


def hydro_pass(runs: DataFrame, columns: DataFrame, water: DataFrame, rivers: DataFrame, lines: DataFrame, origin: Origin) -> DataFrame:
    """Flat water first, then channels on the result."""
    placed = cut_lineage(columns.select(*COLUMN, "lat", "lon").join(surfaces(runs), COLUMN))
    flooded = cut_lineage(co.overlay(runs, hy.water_runs(hy.water_polygon_fill(placed, water, lines))))
    placed = cut_lineage(columns.select(*COLUMN, "lat", "lon").join(surfaces(flooded), COLUMN))
    profile = hy.channel_profile(placed, rivers, lines, water)
    return co.overlay(flooded, hy.hydro_runs(hy.channel_pass(placed, profile, origin.alt, origin.vy)))


def outside_water(hits: DataFrame, water: DataFrame, lines: DataFrame, origin: Origin) -> DataFrame:
    """``vx, vz`` in map water in the chunks with roads and those around them; a crossing reads it beyond its own chunk.

    Water is a polygon outside its holes, or a waterway line up to half its width.
    """
    step = F.array(*[F.lit(d).cast("bigint") for d in (-1, 0, 1)])
    chunks = hits.select("cx", "cz").distinct().withColumn("_dx", F.explode(step)).withColumn("_dz", F.explode(step))
    around = co.chunk_columns(chunks.select((F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cz") + F.col("_dz")).alias("cz")), F.lit(origin.ecef_y))
    segs = explode_segments(lines.select("line_id", "line", rules.waterway_defaults("waterway")["half_width_m"].alias("_half")))
    beside = nearest_segment(around, segs, COLUMN, ["line_id", "seg"], "_half", WIDEST_M)
    return points_inside(around, water, COLUMN, holes="holes").select("vx", "vz").union(beside.select("vx", "vz")).distinct()


def road_pass(runs: DataFrame, columns: DataFrame, roads: DataFrame, water: DataFrame, lines: DataFrame, sample, origin: Origin) -> DataFrame:
    top = surfaces(runs)
    near = cut_lineage(rd.road_columns(columns, roads))
    hits = cut_lineage(rd.road_grade(near, sample, origin.alt, origin.vy).join(top, COLUMN))
    wet = cut_lineage(rd.water_range(runs))
    mode = rd.road_crossing_mode(hits, wet, columns, outside_water(hits, water, lines, origin))
    tunnels = wet.select(*COLUMN, F.col("floor_y").alias("water_floor"))
    return co.overlay(runs, rd.road_runs(hits.join(mode.drop("mode"), COLUMN, "left").join(tunnels, COLUMN, "left")))


def payloads(runs: DataFrame) -> DataFrame:
    """One JSON payload per chunk and layer; a chunk is a bounded box of voxels."""
    cut = co.by_layer(runs)
    item = F.struct("vx", "vz", "y0", "y1", "material")
    packed = cut.groupBy("cx", "cy", "cz").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))
    return packed.select(F.concat_ws("_", "cx", "cy", "cz").alias("chunk"), "payload")


def objects_on_ground(objects: DataFrame, runs: DataFrame, place) -> DataFrame:
    """Objects with their column and the height of its ground; those outside the columns go.

    Objects find their column by an equal join on chunk and column, so they are dealt as the columns are.
    """
    vx, vz = place(F.col("lat"), F.col("lon"))
    found = objects.withColumn("vx", vx).withColumn("vz", vz)
    return found.join(ag.column_ground(runs, COLUMN), ["vx", "vz"]).select(
        *COLUMN, "object_id", "kind", "lat", "lon", F.col("ground_y").cast("double").alias("y"))


#: Passes of the bake in their order; each reads the one before.
CHAIN = ["terrain", "hydro", "roads", "feature_rules", "objects"]


def region_bake(path: str, sources: Sources, grid: Grid, origin: Origin, trees: bool = True, upto: str = "objects") -> PassStore:
    """Run the passes up to one; each reads what the one before stored, of the chunks that still need it.

    A rerun does what is missing: chunks without a pass, or whose pass before was made again (see ``PassStore``).  The
    region's rasters are one more such pass, with the region for its only chunk.
    """
    spark = sources.columns.sparkSession
    rasters = PassStore(spark, f"{path}/rasters", ["region"])
    one = spark.range(1).select(F.lit(grid.region).alias("region"))
    cells = rasters.run(one, "rasters", lambda _: raster_pass(spark, sources, grid))
    store = PassStore(spark, f"{path}/chunks")
    columns = sources.columns
    chunks = cut_lineage(columns.select("cx", "cz").distinct())

    def of(todo: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(todo, ["cx", "cz"], "left_semi")

    def terrain(todo):
        return terrain_pass(sampled_columns(cut_lineage(of(todo, columns)), cells, grid), origin, trees)

    def hydro(todo):
        runs = of(todo, store.read("terrain"))
        if sources.water is None or sources.lines is None or sources.rivers is None:
            return runs
        return hydro_pass(runs, of(todo, columns), sources.water, sources.rivers, sources.lines, origin)

    def roads(todo):
        runs = of(todo, store.read("hydro"))
        if sources.roads is None:
            return runs

        def height(points, ids):
            return el.dem_bilinear(points, cells, grid, ids)

        return road_pass(runs, of(todo, columns), sources.roads, sources.water, sources.lines, height, origin)

    def edits(todo):
        runs = of(todo, store.read("roads"))
        if sources.edits is None:
            return runs
        mine = sources.edits.join(of(todo, columns).select("vx", "vz", "cx", "cz"), ["vx", "vz"])
        return co.overlay(runs, mine.select(*COLUMN, F.col("vy").alias("y0"), F.col("vy").alias("y1"), "material", F.lit(1).alias("ord")))

    def objects(todo):
        return objects_on_ground(sources.objects, of(todo, store.read("feature_rules")), sources.place)

    steps = dict(zip(CHAIN, (terrain, hydro, roads, edits, objects)))
    before = None
    for name in CHAIN[:CHAIN.index(upto) + 1]:
        if name != "objects" or sources.objects is not None:
            store.run(chunks, name, steps[name], before)
            before = name
    return store


def manifest(store: PassStore, path: str, region: str, name: str = "feature_rules") -> DataFrame:
    """Write the chunks' payloads of a pass and list them with size and hash."""
    sinks.write_pass(payloads(store.read(name)), f"{path}/passes", name)
    return sinks.manifest(sinks.read_pass(store.spark.read.parquet(f"{path}/passes"), name), region)
