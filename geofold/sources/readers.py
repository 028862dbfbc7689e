"""Readers for elevation tiles, map elements, coastlines, control sites and logs."""

from __future__ import annotations

import struct as _struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import big
from ..functions.geometry import bbox_of_geometry, bbox_overlap

HGT_SIDES = (1201, 3601)
#: Pixels of a batch of decoded tiles, about.
BATCH_PIXELS = 200_000
DEM_SCHEMA = "tile_lat int, tile_lon int, prow int, pcol int, elev_m smallint"
COAST_SCHEMA = "poly_id bigint, level int, pts array<struct<lat:double,lon:double>>"


def tile_corner(path):
    """South-west corner from a tile's file name, as a (lat, lon) struct; null when it has no known form.

    Forms: N28E153, srtm_s28_e153 and ..._S28_00_E153_00_...
    """
    name = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), "\\.[a-z0-9]+$", "")
    forms = ["^srtm_([ns])(\\d+)_([ew])(\\d+)$", "^([ns])(\\d+)([ew])(\\d+)$", "_([ns])(\\d+)_00_([ew])(\\d+)_00"]

    def part(i):
        return F.coalesce(*[F.nullif(F.regexp_extract(name, f, i), F.lit("")) for f in forms])

    def signed(side, digits, minus):
        return F.when(side == minus, -digits.cast("int")).otherwise(digits.cast("int"))

    return F.struct(signed(part(1), part(2), "s").alias("lat"), signed(part(3), part(4), "w").alias("lon"))


def read_dem_hgt(spark: SparkSession, path: str, sides: tuple[int, ...] = HGT_SIDES) -> DataFrame:
    """Pixels of every HGT tile in a folder; row 0 is north.  One tile is decoded at a time, a row block per batch."""
    return decode_hgt(spark.read.format("binaryFile").load(path).select("path", "content"), sides)


def decode_hgt(files: DataFrame, sides: tuple[int, ...] = HGT_SIDES) -> DataFrame:
    """Pixels of tile files given as ``path, content``.

    Files are dealt to tasks by their tile, as a table of small ones fits a few splits however many pixels it holds, and
    small tiles share a batch.
    """
    files = files.select(tile_corner(F.col("path")).alias("k"), "content")
    files = files.where(F.col("k.lat").isNotNull() & F.col("k.lon").isNotNull()).select("k.lat", "k.lon", "content")
    files = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lat", "lon")

    def pixels(held: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        lat, lon, top, sizes, widths = (np.array(x) for x in zip(*((y, x, t, part.size, part.shape[1]) for y, x, t, part in held)))
        rows, cols = np.divmod(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(widths, sizes))
        rows += np.repeat(top, sizes)
        places = [x.astype("int32") for x in (np.repeat(lat, sizes), np.repeat(lon, sizes), rows, cols)]
        elev = np.concatenate([part.ravel() for *_, part in held])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*places, elev)], ["tile_lat", "tile_lon", "prow", "pcol", "elev_m"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[int, int, int, np.ndarray]] = []
            size = 0
            for lat, lon, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                content = content.as_py()
                side = int(round((len(content) / 2) ** 0.5))
                if side not in sides or side * side * 2 != len(content):
                    raise ValueError(f"elevation tile at {lat}, {lon} has {len(content)} bytes")
                grid = np.frombuffer(content, dtype=">i2").reshape(side, side).astype("int16")
                for top in range(0, side, 64):
                    held.append((lat, lon, top, grid[top : top + 64]))
                    size += held[-1][3].size
                    if size >= BATCH_PIXELS:
                        yield pixels(held)
                        held, size = [], 0
            if held:
                yield pixels(held)

    return files.mapInArrow(decode, DEM_SCHEMA)


ELEMENT_SCHEMA = """version double, generator string, elements array<struct<type:string, id:bigint, lat:double, lon:double,
 nodes:array<bigint>, members:array<struct<type:string,ref:bigint,role:string>>, tags:map<string,string>>>"""


def read_overpass_elements(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Node, way and relation tables from element JSON documents."""
    el = spark.read.schema(ELEMENT_SCHEMA).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    return split_elements(el)


def split_elements(el: DataFrame) -> dict[str, DataFrame]:
    tags = F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    el = el.withColumn("tags", tags)
    return {
        "node": el.where("type = 'node'").select("id", "lat", "lon", "tags"),
        "way": el.where("type = 'way'").select("id", "nodes", "tags"),
        "relation": el.where("type = 'relation'").select("id", "members", "tags"),
    }


def read_osm_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Node, way and relation tables of an extract exported to Parquet."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("node", "way", "relation")}


def way_nodes(ways: DataFrame) -> DataFrame:
    """Ordered node ids of ways as rows."""
    return ways.select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("seq", "node_id")).withColumn("seq", big(F.col("seq")))


def read_coastline(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, level: int = 1) -> DataFrame:
    """Polygons of a level from binary shoreline files, optionally those whose box meets ``(s, n, w, e)``.

    Records are an 11-integer header and micro-degree (x, y) pairs, big-endian; longitudes above 180 wrap.
    """
    polys = decode_coastline(spark.read.format("binaryFile").load(path).select("content")).where(F.col("level") == level)
    if box is None:
        return polys
    s, n, w, e = box
    want = F.struct(F.lit(s).alias("lat_min"), F.lit(n).alias("lat_max"), F.lit(w).alias("lon_min"), F.lit(e).alias("lon_max"))
    return polys.where((F.size("pts") >= 3) & bbox_overlap(bbox_of_geometry("pts"), want))


def decode_coastline(files: DataFrame) -> DataFrame:
    """Polygons of all levels of shoreline files given as ``content``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                at = 0
                while at + 44 <= len(content):
                    head = _struct.unpack(">11i", content[at : at + 44])
                    n, at = head[1], at + 44
                    xy = np.frombuffer(content, dtype=">i4", count=2 * n, offset=at).reshape(n, 2) / 1e6
                    at += 8 * n
                    lon = np.where(xy[:, 0] > 180.0, xy[:, 0] - 360.0, xy[:, 0])
                    pts = [{"lat": float(a), "lon": float(b)} for a, b in zip(xy[:, 1], lon)]
                    yield pd.DataFrame({"poly_id": [head[0]], "level": [head[2] & 255], "pts": [pts]})

    return files.mapInPandas(decode, COAST_SCHEMA)


ATLAS_SCHEMA = """name string, default_window_m double, default_image_size bigint, categories array<struct<id:string, name:string,
 expected_min_controls:bigint, controls:array<struct<id:string, label:string, lat:double, lon:double, window_m:double, image_size:bigint,
 reference_orthometric_alt_m:double, reference_status:string, tags:array<string>>>>>"""
DEFAULT_WINDOW_M = 240.0


def read_control_atlas(spark: SparkSession, path: str, **filters) -> DataFrame:
    return control_sites(spark.read.schema(ATLAS_SCHEMA).json(path, multiLine=True), **filters)


def control_sites(atlas: DataFrame, categories=None, ids=None, per_category: int | None = None) -> DataFrame:
    """One row per control site, with the atlas defaults filled in; filters by category, id and first N per category."""
    cat = atlas.select("default_window_m", "default_image_size", F.explode("categories").alias("c"))
    sites = cat.select("*", F.posexplode("c.controls").alias("pos", "s")).select(
        F.col("c.id").alias("category"), F.col("c.expected_min_controls").alias("expected_min"), "pos",
        F.col("s.id").alias("site_id"), "s.label", "s.lat", "s.lon",
        F.coalesce("s.window_m", "default_window_m", F.lit(DEFAULT_WINDOW_M)).alias("window_m"),
        F.coalesce("s.image_size", "default_image_size").alias("image_size"),
        F.col("s.reference_orthometric_alt_m").alias("reference_m"), F.col("s.reference_status").alias("reference_status"),
    )
    if categories is not None:
        sites = sites.where(F.col("category").isin(*categories))
    if ids is not None:
        sites = sites.where(F.col("site_id").isin(*ids))
    if per_category is not None:
        w = Window.partitionBy("category").orderBy("pos")
        sites = sites.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_category).drop("_rn")
    return sites


def unseen_ops(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Ops of a log whose id is not known yet, each once."""
    return incoming.dropDuplicates(["op_id"]).join(known.select("op_id"), "op_id", "left_anti")


def read_op_log(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    ops = spark.read.parquet(path)
    return ops.dropDuplicates(["op_id"]) if known is None else unseen_ops(ops, known)
