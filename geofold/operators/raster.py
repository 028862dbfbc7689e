"""Focal and path operators on grid cells ``(region, r, c, value)``.

Row 0 is south and column 0 west.  Cells are shuffled once, by square block, and every block also receives a
one-cell rim of its neighbours; the windows that follow are keyed below the block and reuse that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import M_PER_DEG, big, col
from ..session import cut_lineage

REGION = ("region",)
# D8 directions clockwise from north, as (row step, column step).
D8 = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
D8_NAMES = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]
SQRT2 = float(np.sqrt(2.0))
COAST_CAP_M = 50000.0


def with_block(cells: DataFrame, block: int, rim: int = 1) -> DataFrame:
    """Replicate each cell to its block and to the blocks whose rim it lies in; adds ``br, bc, rim``."""

    def reach(name):
        return F.array_distinct(F.array(*[big(F.floor((F.col(name) + d) / block)) for d in (-rim, 0, rim)]))

    target = F.flatten(
        F.transform(reach("r"), lambda a: F.transform(reach("c"), lambda b: F.struct(a.alias("br"), b.alias("bc"))))
    )
    out = cells.withColumn("_b", F.explode(target)).select("*", "_b.br", "_b.bc").drop("_b")
    return out.withColumn(
        "rim", (F.floor(F.col("r") / block) != F.col("br")) | (F.floor(F.col("c") / block) != F.col("bc"))
    )


def neighbours(cells: DataFrame, value: str = "z", region: Sequence[str] = REGION, block: int = 256) -> DataFrame:
    """Add the eight neighbour values ``z_n .. z_nw`` (null where there is no cell), for grids with or without holes.

    Beside each gap of a row an empty place is put in, so that the rows above and below still find their diagonal
    neighbours across it.  A full grid gets such places at the ends of its rows only.
    """
    region = list(region)
    # One hash column names the block, so the windows below find the rows already clustered by it.
    placed = with_block(cells, block).withColumn("bk", F.xxhash64(*region, "br", "bc")).repartition("bk")
    block_keys = ["bk"] + region + ["br", "bc"]
    keep = [c for c in cells.columns if c not in region + ["r", "c", value]]
    body = F.struct(F.col(value).alias("v"), *[F.col(c) for c in keep])
    row = Window.partitionBy(*block_keys, "r").orderBy("c")
    wide = placed.select(
        *block_keys, "r", "c", "rim", body.alias("_own"), F.col(value).alias("_v"), F.lag("c").over(row).alias("_pc"), F.lead("c").over(row).alias("_nc"),
        F.lag(value).over(row).alias("_pv"), F.lead(value).over(row).alias("_nv"),
    )
    c, before, after = F.col("c"), F.col("_pc"), F.col("_nc")

    def place(at, west, east, own=False):
        mine = F.lit(own)
        return F.struct(at.alias("c"), F.when(mine, F.col("rim")).alias("rim"), F.when(mine, F.col("_own")).alias("own"), west.alias("w"), east.alias("e"))

    none = F.when(F.lit(False), F.col("_v"))
    here = place(c, F.when(before == c - 1, F.col("_pv")), F.when(after == c + 1, F.col("_nv")), own=True)
    east_gap = F.when(after.isNull() | (after > c + 1), place(c + 1, F.col("_v"), F.when(after == c + 2, F.col("_nv"))))
    west_gap = F.when(before.isNull() | (before < c - 2), place(c - 1, none, F.col("_v")))
    wide = wide.select(*block_keys, "r", F.explode(F.array_compact(F.array(here, east_gap, west_gap))).alias("_p"))
    wide = wide.select(*block_keys, "r", "_p.c", "_p.rim", F.col("_p.own").alias("_own"), F.col("_p.w").alias("_w"), F.col("_p.e").alias("_e"))
    column = Window.partitionBy(*block_keys, "c").orderBy("r")
    line = F.struct(F.col("r").alias("r"), F.col("_w").alias("w"), F.col("_own.v").alias("v"), F.col("_e").alias("e"))
    wide = wide.withColumn("_s", F.lag(line).over(column)).withColumn("_n", F.lead(line).over(column))
    north = F.col("_n.r") == F.col("r") + 1
    south = F.col("_s.r") == F.col("r") - 1
    return wide.where(~F.col("rim") & F.col("_own").isNotNull()).select(
        *region, "r", "c",
        F.col("_own.v").alias(value),
        *[F.col(f"_own.{c}").alias(c) for c in keep],
        F.when(north, F.col("_n.v")).alias(f"{value}_n"),
        F.when(north, F.col("_n.e")).alias(f"{value}_ne"),
        F.col("_e").alias(f"{value}_e"),
        F.when(south, F.col("_s.e")).alias(f"{value}_se"),
        F.when(south, F.col("_s.v")).alias(f"{value}_s"),
        F.when(south, F.col("_s.w")).alias(f"{value}_sw"),
        F.col("_w").alias(f"{value}_w"),
        F.when(north, F.col("_n.w")).alias(f"{value}_nw"),
    )


def drop_neighbours(df: DataFrame, value: str = "z") -> DataFrame:
    return df.drop(*[f"{value}_{d}" for d in D8_NAMES])


def with_slope_aspect(df: DataFrame, cell_deg: float, value: str = "z", cos_lat: Column | None = None) -> DataFrame:
    """Horn slope in degrees and the azimuth of the gradient; edges repeat the border cell."""
    z = F.col(value)
    v = {d: F.col(f"{value}_{d}") for d in D8_NAMES}
    n, s = F.coalesce(v["n"], z), F.coalesce(v["s"], z)
    e, w = F.coalesce(v["e"], z), F.coalesce(v["w"], z)
    ne, nw = F.coalesce(v["ne"], v["n"], v["e"], z), F.coalesce(v["nw"], v["n"], v["w"], z)
    se, sw = F.coalesce(v["se"], v["s"], v["e"], z), F.coalesce(v["sw"], v["s"], v["w"], z)
    size = F.lit(8.0 * M_PER_DEG * cell_deg)
    dx = (se + e * 2.0 + ne - sw - w * 2.0 - nw) / (size if cos_lat is None else size * cos_lat)
    dy = (nw + n * 2.0 + ne - sw - s * 2.0 - se) / size
    out = df.withColumn("_dx", dx).withColumn("_dy", dy)
    return (
        out.withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))))
        .withColumn("gradient_azimuth", F.pmod(F.degrees(F.atan2("_dx", "_dy")) + 360.0, F.lit(360.0)))
        .drop("_dx", "_dy")
    )


def tri(value: str = "z") -> Column:
    """Mean absolute difference to the existing neighbours."""
    diffs = F.filter(
        F.array(*[F.abs(F.col(value) - F.col(f"{value}_{d}")) for d in D8_NAMES]), lambda d: d.isNotNull()
    )
    total = F.aggregate(diffs, F.lit(0.0), lambda a, d: a + d)
    return F.when(F.size(diffs) > 0, total / F.size(diffs)).otherwise(0.0)


def d8_direction(cell_deg: float, value: str = "z") -> Column:
    """Steepest strictly downhill neighbour, 0..7 clockwise from north; 8 is a sink; the first wins ties."""
    cell_m = M_PER_DEG * cell_deg
    drops = []
    for name, (dr, dc) in zip(D8_NAMES, D8):
        length = cell_m * (SQRT2 if dr and dc else 1.0)
        drops.append(F.coalesce((F.col(value) - F.col(f"{value}_{name}")) / F.lit(length), F.lit(-1.0)))
    best = F.greatest(*drops)
    return F.when(best > 0.0, F.array_position(F.array(*drops), best) - 1).otherwise(8).cast("bigint")


def twi(acc, slope_deg) -> Column:
    return F.log(F.greatest(col(acc).cast("double"), F.lit(1.0)) / F.tan(F.greatest(F.radians(col(slope_deg)), F.lit(0.001))))


def terrain(cells: DataFrame, cell_deg: float, region: Sequence[str] = REGION) -> DataFrame:
    """Slope, gradient azimuth, ruggedness and D8 direction from one shuffle."""
    near = neighbours(cells, "z", region)
    near = near.withColumn("tri", tri()).withColumn("dir", d8_direction(cell_deg))
    return drop_neighbours(with_slope_aspect(near, cell_deg))


# ---------------------------------------------------------------------------------------------------------
# Flow accumulation
# ---------------------------------------------------------------------------------------------------------
def _follow(direction: np.ndarray, r: np.ndarray, c: np.ndarray, block: int):
    """Cell numbers, next cell within the block (-1 when none) and the cell each one drains to."""
    step = np.array([d for d in D8] + [(0, 0)])
    to_r, to_c = r + step[direction, 0], c + step[direction, 1]
    here = {"r": r // block, "c": c // block}
    local = (direction < 8) & (to_r // block == here["r"]) & (to_c // block == here["c"])
    table = np.full(block * block, -1, dtype=np.int64)
    table[(r % block) * block + c % block] = np.arange(len(r))
    nxt = np.where(local, table[(to_r % block) * block + to_c % block], -1)
    return nxt, to_r, to_c


def _subtree_sums(weight: np.ndarray, nxt: np.ndarray):
    """Sum of weights over each node's upstream tree, and its last node downstream, by pointer doubling."""
    total, ptr = weight.astype(np.int64).copy(), nxt.copy()
    end = np.where(nxt >= 0, nxt, np.arange(len(nxt)))
    while True:
        live = np.flatnonzero(ptr >= 0)
        if not len(live):
            break
        add = np.zeros_like(total)
        np.add.at(add, ptr[live], total[live])
        total += add
        ptr_next = np.full_like(ptr, -1)
        ptr_next[live] = ptr[ptr[live]]
        ptr = ptr_next
        end = end[end]
    return total, end


def flow_accumulation(dirs: DataFrame, region: Sequence[str] = REGION, block: int = 256) -> DataFrame:
    """Cells draining through each cell, itself included, along the D8 forest ``(region, r, c, dir)``.

    Blocks are summed on their own, then only the cells where water leaves a block are linked across blocks and
    summed by pointer doubling (a share of about 4 / block of the cells), and the inflow is passed back down
    inside each block.
    """
    region = list(region)
    keys = region + ["br", "bc"]
    key_schema = ", ".join(f"{c} {dict(dirs.dtypes)[c]}" for c in region)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        nxt, to_r, to_c = _follow(pdf["dir"].to_numpy(), r, c, block)
        total, end = _subtree_sums(np.ones(len(r)), nxt)
        leaves = (pdf["dir"].to_numpy()[end] < 8) & (nxt[end] < 0)
        return pdf.assign(
            acc=total, end_r=r[end], end_c=c[end], to_r=to_r[end], to_c=to_c[end], leaves=leaves
        )

    placed = dirs.select(
        *region, "r", "c", "dir", big(F.floor(F.col("r") / block)).alias("br"), big(F.floor(F.col("c") / block)).alias("bc")
    )
    local_schema = (
        f"{key_schema}, r bigint, c bigint, dir bigint, br bigint, bc bigint, acc bigint, end_r bigint, end_c bigint, "
        "to_r bigint, to_c bigint, leaves boolean"
    )
    local = cut_lineage(placed.groupBy(*keys).applyInPandas(inside, local_schema))

    # Exits are cells whose water crosses a block side; each drains to a cell that reaches another exit or a sink.
    exits = local.where(F.col("leaves") & (F.col("r") == F.col("end_r")) & (F.col("c") == F.col("end_c"))).select(
        *region, "r", "c", "acc", "to_r", "to_c"
    )
    down = local.select(
        *region, F.col("r").alias("to_r"), F.col("c").alias("to_c"),
        F.when(F.col("leaves"), F.col("end_r")).alias("p_r"), F.when(F.col("leaves"), F.col("end_c")).alias("p_c"),
    )
    links = cut_lineage(exits.join(down, region + ["to_r", "to_c"]))
    state = links.select(*region, "r", "c", F.col("acc").alias("total"), "p_r", "p_c")
    while state.where(F.col("p_r").isNotNull()).limit(1).count():
        sent = (
            state.where(F.col("p_r").isNotNull())
            .groupBy(*region, F.col("p_r").alias("r"), F.col("p_c").alias("c"))
            .agg(F.sum("total").alias("_in"))
        )
        jump = state.select(
            *region, F.col("r").alias("p_r"), F.col("c").alias("p_c"), F.col("p_r").alias("_r"), F.col("p_c").alias("_c")
        )
        state = cut_lineage(
            state.join(sent, region + ["r", "c"], "left")
            .withColumn("total", F.col("total") + F.coalesce(F.col("_in"), F.lit(0)))
            .join(jump, region + ["p_r", "p_c"], "left")
            .select(*region, "r", "c", "total", F.col("_r").alias("p_r"), F.col("_c").alias("p_c"))
        )
    inflow = (
        links.select(*region, "r", "c", "to_r", "to_c")
        .join(state.select(*region, "r", "c", "total"), region + ["r", "c"])
        .groupBy(*region, F.col("to_r").alias("r"), F.col("to_c").alias("c"))
        .agg(F.sum("total").alias("inflow"))
    )

    def with_inflow(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
        nxt, _, _ = _follow(pdf["dir"].to_numpy(), r, c, block)
        total, _ = _subtree_sums(1 + pdf["inflow"].to_numpy(), nxt)
        return pdf[region + ["r", "c"]].assign(acc=total)

    body = (
        local.select(*keys, "r", "c", "dir")
        .join(inflow, region + ["r", "c"], "left")
        .withColumn("inflow", F.coalesce(F.col("inflow"), F.lit(0)))
    )
    return body.groupBy(*keys).applyInPandas(with_inflow, f"{key_schema}, r bigint, c bigint, acc bigint")


# ---------------------------------------------------------------------------------------------------------
# Distances and rings
# ---------------------------------------------------------------------------------------------------------
#: Reach of the rounds of the search for far shores, in metres; the last is the cap.
COAST_RINGS_M = (2_000.0, 10_000.0, COAST_CAP_M)


def far_coast(cells: DataFrame, segments: DataFrame, region: Sequence[str] = REGION, rings: Sequence[float] = COAST_RINGS_M) -> DataFrame:
    """Exact distance ``coast_m`` of cells (``lat, lon``) to the nearest shore segment (``line_id, seg, a, b``), within the last ring.

    Rings grow: each round looks for segments within its reach around the cells that no smaller ring settled, so a cell
    near a shore never meets the far ones.  Cells with none get the last reach.
    """
    from .spatial_join import nearest_distance

    keys, segments = [*region, "r", "c"], cut_lineage(segments.select("a", "b").distinct())
    left, found = cells.select(*keys, "lat", "lon"), None
    for reach in rings:
        near = cut_lineage(nearest_distance(left, segments, keys, reach).select(*keys, F.col("dist_m").alias("coast_m")))
        found = near if found is None else found.unionByName(near)
        left = cut_lineage(left.join(near.select(*keys), keys, "left_anti"))
    return found.unionByName(left.select(*keys, F.lit(float(rings[-1])).alias("coast_m")))


def coast_distance(cells: DataFrame, cell_deg: float, region: Sequence[str] = REGION, mark: str = "coast", segments: DataFrame | None = None) -> DataFrame:
    """4-connected distance in metres to the nearest marked cell of a full grid, capped at 50 km.

    Without obstacles the step count is the Manhattan distance, which splits into a pass along rows and one
    along columns.  Windows only look back, in both orders, so they run in one sweep each.  Regions without a marked
    cell take exact distances to ``segments`` (cells then have ``lat, lon``), or the cap if there are none.
    """
    region = list(region)
    if segments is not None:
        cells = cut_lineage(cells)
        shore = cut_lineage(cells.where(F.col(mark)).select(*region).distinct())
        near = coast_distance(cells.join(shore, region, "left_semi"), cell_deg, region, mark)
        keys = [*region, "r", "c"]
        far = far_coast(cells.join(shore, region, "left_anti"), segments, region)
        return cells.join(near.select(*keys, "coast_m").unionByName(far), keys)
    cell_m = M_PER_DEG * cell_deg

    def both(df, part, axis, seen, out, add):
        up = Window.partitionBy(*part).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*part).orderBy(F.desc(axis)).rowsBetween(Window.unboundedPreceding, 0)
        lo = F.min(seen - F.col(axis)).over(up) + F.col(axis)
        hi = F.min(seen + F.col(axis)).over(down) - F.col(axis)
        df = df.withColumn("_lo", lo).withColumn("_hi", hi)
        return df.withColumn(out, F.least(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")

    zero = F.when(F.col(mark), F.lit(0).cast("bigint"))
    rows = both(cells, region + ["r"], "c", zero, "_g", 0)
    steps = both(rows, region + ["c"], "r", F.col("_g"), "steps", 0).drop("_g")
    metres = F.col("steps") * cell_m
    return steps.withColumn(
        "coast_m",
        F.when((F.col("steps") - 1) * cell_m < COAST_CAP_M, metres).otherwise(COAST_CAP_M),
    ).drop("steps")


def dilate_mask(cells: DataFrame, mark: str, radius: int, region: Sequence[str] = REGION, out: str = "dilated") -> DataFrame:
    """Square dilation: marked cells spread along rows, then along columns; only marked cells are exploded."""
    keys = list(region) + ["r", "c"]

    def reach(axis):
        return F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))

    wide = cells.where(F.col(mark)).select(*region, "r", reach("c").alias("c")).distinct()
    tall = wide.select(*region, reach("r").alias("r"), "c").distinct()
    return cells.join(tall.withColumn(out, F.lit(True)), keys, "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(False))
    )


def halo_rings(inside: DataFrame, source: Sequence[str], max_ring: int = 2) -> DataFrame:
    """Cells around each source's cells with their 8-connected ring number 1..max_ring."""
    source = list(source)
    span = F.sequence(F.lit(-max_ring), F.lit(max_ring))
    near = (
        inside.withColumn("_dr", F.explode(span))
        .withColumn("_dc", F.explode(span))
        .select(
            *source,
            (F.col("r") + F.col("_dr")).cast("bigint").alias("r"),
            (F.col("c") + F.col("_dc")).cast("bigint").alias("c"),
            F.greatest(F.abs("_dr"), F.abs("_dc")).cast("bigint").alias("ring"),
        )
        .groupBy(*source, "r", "c")
        .agg(F.min("ring").alias("ring"))
    )
    return near.where(F.col("ring") > 0)


def local_relief(cells: DataFrame, value: str = "z", region: Sequence[str] = REGION) -> DataFrame:
    """3x3 maximum minus minimum and the larger central difference, missing neighbours read as the centre."""
    near = neighbours(cells, value, region)
    v = [F.coalesce(F.col(f"{value}_{d}"), F.col(value)) for d in D8_NAMES] + [F.col(value)]
    n, e, s, w = v[0], v[2], v[4], v[6]
    out = near.withColumn("relief", F.greatest(*v) - F.least(*v))
    return drop_neighbours(out.withColumn("local_slope", F.greatest(F.abs(e - w), F.abs(n - s)) / 2.0), value)


def column_slope(columns: DataFrame, chunk: Sequence[str], x: str = "vx", z: str = "vz", y: str = "surface_y") -> DataFrame:
    """Slope of integer surface heights per chunk: central differences, one-sided at chunk sides."""
    chunk = list(chunk)

    def grad(part, axis):
        w = Window.partitionBy(*chunk, part).orderBy(axis)
        lo, hi = F.coalesce(F.lag(y).over(w), F.col(y)), F.coalesce(F.lead(y).over(w), F.col(y))
        at_lo, at_hi = F.coalesce(F.lag(axis).over(w), F.col(axis)), F.coalesce(F.lead(axis).over(w), F.col(axis))
        return (hi - lo) / F.greatest(at_hi - at_lo, F.lit(1))

    out = columns.withColumn("_gx", grad(z, x)).withColumn("_gz", grad(x, z))
    return out.withColumn(
        "slope_deg", F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gz") * F.col("_gz"))))
    ).drop("_gx", "_gz")
