"""Sources and sinks shared by the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.sinks import new_folder


def parquet_stream(spark: SparkSession, folder: str, file: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files ``file`` of a folder, or of a table ``file`` that is itself a folder of files.

    The schema is taken from those present.
    """
    try:
        schema = spark.read.option("pathGlobFilter", file).parquet(folder).schema
    except AnalysisException:  # no file has that name
        folder, file = f"{folder}/{file}", "*"
        schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_parquet(stream: DataFrame, name: str) -> DataFrame:
    """Drain the available input into Parquet files on shared storage and return them as a table."""
    base = new_folder(shared_dir(stream.sparkSession), name)
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/data")


#: Hash buckets of an upserted table; a batch rewrites those its keys fall in.
BUCKETS = 16


def run_upserts(
    stream: DataFrame, name: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], key: Sequence[str], mode: str = "append", buckets: int = BUCKETS,
) -> DataFrame:
    """Drain the available input into a table hashed by ``key``, merging each batch by ``merge(rows or None, batch)``.

    ``merge`` must treat keys by themselves and keep the table's key columns.  A batch reads and rewrites the buckets its
    rows fall in and no others, so its cost does not grow with the table if there are enough buckets.  Each bucket has
    two slots: a batch writes the one not in use and then a small list of the slots in use, so a replayed batch starts
    from the list before its own and writes the same again, and a bucket's older version goes when the next one is
    written over it.
    """
    spark = stream.sparkSession
    base = new_folder(shared_dir(spark), name)
    table, latest = f"{base}/table", {"i": None}
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def slots(s: SparkSession, i: int) -> dict[int, int]:
        return {} if i < 0 else {r["bucket"]: r["slot"] for r in s.read.parquet(f"{base}/slots/{i % 2}").collect()}  # one row a bucket

    def held(s: SparkSession, used: dict[int, int]) -> DataFrame:
        place = F.concat_ws(".", "slot", "bucket")
        rows = s.read.parquet(table).where(place.isin([f"{slot}.{b}" for b, slot in used.items()]) & F.col("_live"))
        return rows.drop("slot", "bucket", "_live")

    def apply(batch: DataFrame, i: int) -> None:
        s = batch.sparkSession
        before = slots(s, i - 1)
        batch = batch.persist()
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]
        known = {b: before[b] for b in touched if b in before}
        out = merge(held(s, known) if known else None, batch).withColumn("bucket", bucket).withColumn("_live", F.lit(True))
        # A row of its own for each bucket, so that one left empty is written over, too.
        marks = s.createDataFrame([(b,) for b in touched], "bucket int").withColumn("_live", F.lit(False))
        slot = F.lit(0)
        for b, at in known.items():
            slot = F.when(F.col("bucket") == b, 1 - at).otherwise(slot)
        out = out.unionByName(marks, allowMissingColumns=True).withColumn("slot", slot)
        (
            out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("slot", "bucket").parquet(table)
        )
        after = {**before, **{b: 1 - before.get(b, 1) for b in touched}}
        s.createDataFrame(sorted(after.items()), "bucket int, slot int").coalesce(1).write.mode("overwrite").parquet(f"{base}/slots/{i % 2}")
        batch.unpersist()
        latest["i"] = i

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    if latest["i"] is None:
        raise RuntimeError(f"stream {name} had no input")
    return held(spark, slots(spark, latest["i"]))
