"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, columns still pruned, survives executors.

    Columns ``by`` become folders, so that a filter on them reads its files alone.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Empty stored tables that nothing will read again; an empty write replaces their files in any store."""
    for t in tables:
        path = _paths.pop(t)
        t.sparkSession.createDataFrame([], t.schema).write.mode("overwrite").parquet(path)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo ``n``; a null key is fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use."""
    while base.lower() in {c.lower() for c in df.columns}:
        base += "_"
    return base


def batches(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with a function from one batch's columns (a dict of lists) to columns in the schema's order."""
    names = df.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield from fn({n: b.column(i) for i, n in enumerate(names)})

    return df.mapInArrow(run, schema)


def remembered(name: str, make, version=None):
    """What a worker process keeps between tasks under ``name``; functions sent by value lose their module's globals.

    Of things with a version only one is kept in all, so that a worker's memory does not grow with the jobs it has seen.
    """
    store = sys.modules.setdefault("_kept_between_tasks", types.ModuleType("_kept_between_tasks")).__dict__
    if version is None:
        if name not in store:
            store[name] = make()
        return store[name]
    held = store.get("versioned", (None, None))
    if held[0] != (name, version):
        store["versioned"] = held = ((name, version), None if make is None else make())
    return held[1]
