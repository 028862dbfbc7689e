"""Tile, pass, manifest and log stores as partitioned Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oplog import dedup_signature, ops_by_chunk

# Passes in the order they run, with their current versions.
PASSES = ["terrain", "substrate", "hydro", "roads", "buildings", "feature_rules"]
PASS_VERSION = {"terrain": 1, "substrate": 1, "hydro": 1, "roads": 1, "buildings": 1, "feature_rules": 1}
PASS_RANK = {p: i for i, p in enumerate(PASSES)}


def new_folder(base: str, name: str) -> str:
    """Path of a fresh folder under shared storage."""
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_tiles(features: DataFrame, path: str, skip_existing: bool = False) -> None:
    """Write features under ``tile_s, tile_w``; whole tiles are replaced, or kept when ``skip_existing``.

    Rows of a hot tile are spread over files by feature hash, so one tile never makes one task.
    """
    spark, keys = features.sparkSession, ["tile_s", "tile_w"]
    rows = features
    if skip_existing and _exists(spark, path):
        held = spark.read.parquet(path).select(*keys).distinct()
        rows = rows.join(held, keys, "left_anti")
    spread = F.pmod(F.xxhash64("feature_id"), F.lit(4))
    (
        rows.repartition(*keys, spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether Parquet files are there; asked through the reader, so any store and Spark Connect will do."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def write_pass(chunks: DataFrame, path: str, name: str, version: int | None = None) -> None:
    """Write chunk payloads of one pass; a new version is a new partition, a rerun replaces its own."""
    version = PASS_VERSION[name] if version is None else version
    rows = chunks.withColumn("checksum", F.sha2("payload", 256)).withColumn("pass", F.lit(name)).withColumn("version", F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass", "version").parquet(path)


def current(store: DataFrame) -> DataFrame:
    """Rows of each pass at its current version; prunes partitions."""
    keep = F.lit(False)
    for name, version in PASS_VERSION.items():
        keep = keep | ((F.col("pass") == name) & (F.col("version") == version))
    return store.where(keep)


def read_pass(store: DataFrame, name: str) -> DataFrame:
    return current(store).where(F.col("pass") == name)


def pass_status(store: DataFrame, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """One boolean column per pass for each chunk."""
    have = current(store).groupBy(*keys).pivot("pass", PASSES).agg(F.lit(True))
    return have.select(*keys, *[F.coalesce(F.col(p), F.lit(False)).alias(p) for p in PASSES])


def best_pass(store: DataFrame, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """Most processed current payload of each chunk."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p, i in PASS_RANK.items() for x in (p, i)]), F.col("pass"))
    best = current(store).groupBy(*keys).agg(F.max_by(F.struct("pass", "payload"), rank).alias("_b"))
    return best.select(*keys, "_b.*")


def pass_coverage(store: DataFrame) -> DataFrame:
    return store.groupBy("pass", "version").agg(F.count(F.lit(1)).alias("n"))


def preferred_output_pass(skip_features: bool = False, skip_roads: bool = False, skip_water: bool = False) -> str:
    """Last pass to run under the skip flags."""
    if not skip_features:
        if not skip_roads:
            return "roads"
        if not skip_water:
            return "hydro"
    return "terrain"


def resume_missing(chunks: DataFrame, store: DataFrame, target: str, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """Chunks without the target pass."""
    return chunks.join(store.where(F.col("pass") == target).select(*keys), list(keys), "left_anti")


def verify_tiles(store: DataFrame) -> DataFrame:
    """Total and corrupt rows per pass, by recomputed checksum."""
    bad = ~F.sha2("payload", 256).eqNullSafe(F.col("checksum"))
    return store.groupBy("pass").agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("corrupt"))


def good_tiles(store: DataFrame) -> DataFrame:
    """Rows whose checksum holds."""
    return store.where(F.sha2("payload", 256).eqNullSafe(F.col("checksum")))


def purge_tiles(store: DataFrame, family: str, keep_keys: DataFrame | None = None, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """The store without a family, or without single keys of it."""
    if keep_keys is None:
        return store.where(F.col("pass") != family)
    gone = keep_keys.select(*keys).distinct().withColumn("pass", F.lit(family))
    return store.join(gone, [*keys, "pass"], "left_anti")


def manifest(store: DataFrame, region: str, keys: Sequence[str] = ("chunk",)) -> DataFrame:
    """Size and hash per chunk with the region's header columns."""
    return store.select(*keys, F.lit(region).alias("region"), F.length("payload").cast("bigint").alias("size"), F.sha2("payload", 256).alias("hash"))


def write_manifest(store: DataFrame, path: str, region: str, keys: Sequence[str] = ("chunk",)) -> None:
    """Manifest as JSON lines in chunk order over the files; range partitions keep the sort parallel."""
    manifest(store, region, keys).orderBy(*keys).write.mode("overwrite").json(path)


def z_order(x, y) -> Column:
    """Bits of two whole numbers (from -2^30 to 2^30) in turns, so places near each other mostly have near numbers."""
    def spread(v: Column) -> Column:
        v = v.cast("bigint") + (1 << 30)
        for step in (16, 8, 4, 2, 1):
            every = ((1 << 64) - 1) // ((1 << step) + 1)  # runs of ``step`` set bits with gaps of as many
            v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(every))
        return v

    return spread(F.col(x)).bitwiseOR(F.shiftleft(spread(F.col(y)), 1))


def write_op_chunks(ops: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Deduplicated ops under every chunk they affect, in files of at most ``file_rows`` rows.

    Rows are ranged by the chunk's place on a Z curve, then in replay order, so a file holds neighbouring chunks, a hot
    chunk goes over many files, and files sorted by name replay each chunk in order.  A filter on ``cx`` and ``cz`` skips
    files and row groups by their statistics.
    """
    order = [z_order("cx", "cz"), F.col("cx"), F.col("cz"), F.col("lamport"), F.col("author"), F.col("op_id")]
    fanned = ops_by_chunk(dedup_signature(ops))
    fanned.orderBy(*order).write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
