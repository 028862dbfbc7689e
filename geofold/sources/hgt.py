"""Elevation tile files as a data source: one partition a tile and row block, and filters on the tile choose the files."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .readers import DEM_SCHEMA, HGT_SIDES

#: Rows of a partition.
BLOCK = 256
#: Fixed forms of a tile's file name, without its ending.
FORMS = [r"^srtm_([ns])(\d+)_([ew])(\d+)$", r"^([ns])(\d+)([ew])(\d+)$", r"_([ns])(\d+)_00_([ew])(\d+)_00"]
TESTS = {
    EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value, LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value,
}


def corner_of(name: str) -> tuple[int, int] | None:
    """South-west corner (lat, lon) from a file's name."""
    stem = re.sub(r"\.[a-z0-9]+$", "", name.lower())
    for form in FORMS:
        m = re.search(form, stem)
        if m:
            return int(m[2]) * (-1 if m[1] == "s" else 1), int(m[4]) * (-1 if m[3] == "w" else 1)
    return None


@dataclass
class Rows(InputPartition):
    """Some rows of one tile's file."""

    path: str
    lat: int
    lon: int
    side: int
    top: int


class HgtReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.sides = [int(s) for s in options.get("sides", ",".join(map(str, HGT_SIDES))).split(",")]
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("tile_lat",), ("tile_lon",)):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Rows]:
        files, base = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        out = []
        for info in files.get_file_info(fs.FileSelector(base)):
            at = corner_of(info.base_name) if info.is_file else None
            if at is None or not all(TESTS[type(f)](at[0] if f.attribute == ("tile_lat",) else at[1], f) for f in self.wanted):
                continue
            side = round((info.size / 2) ** 0.5)
            if side not in self.sides or side * side * 2 != info.size:
                raise ValueError(f"elevation tile {info.base_name} has {info.size} bytes")
            out += [Rows(info.path, *at, side, top) for top in range(0, side, BLOCK)]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.path)[0] if ":" in self.path else fs.LocalFileSystem()
        many = min(BLOCK, part.side - part.top)
        with files.open_input_file(part.path) as f:
            f.seek(2 * part.side * part.top)
            grid = np.frombuffer(f.read(2 * part.side * many), ">i2").astype("int16")
        n = len(grid)
        rows, cols = np.divmod(np.arange(n, dtype="int32"), part.side)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part.lat, "int32")), pa.array(np.full(n, part.lon, "int32")), pa.array(rows + np.int32(part.top), pa.int32()), pa.array(cols.astype("int32")), pa.array(grid)],
            ["tile_lat", "tile_lon", "prow", "pcol", "elev_m"])


class HgtSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hgt"

    def schema(self) -> str:
        return DEM_SCHEMA

    def reader(self, schema) -> HgtReader:
        return HgtReader(dict(self.options))


def read_hgt(spark: SparkSession, path: str, sides: Sequence[int] = HGT_SIDES) -> DataFrame:
    """Pixels of a folder's tiles; filters on ``tile_lat`` and ``tile_lon`` decide which files are opened at all.

    The driver lists the folder's names; a task reads its rows' bytes alone.  Turns on filters for Python sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HgtSource)
    return spark.read.format("hgt").option("sides", ",".join(map(str, sides))).load(path)


def write_hgt(tiles: DataFrame, path: str) -> int:
    """Write ``lat, lon, content`` as one file a tile; returns the number of files.  A task retried writes the same file again."""
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        files.create_dir(base, recursive=True)
        for b in batches:
            for lat, lon, content in zip(b["lat"], b["lon"], b["content"]):
                name = f"{'S' if lat < 0 else 'N'}{abs(lat):02d}{'W' if lon < 0 else 'E'}{abs(lon):03d}.hgt"
                with files.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
            yield pd.DataFrame({"n": [len(b)]})

    return tiles.mapInPandas(put, "n bigint").groupBy().sum("n").first()[0] or 0
