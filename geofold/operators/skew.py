"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose hot keys are split over several tasks.

    ``spread`` names columns of ``big`` that identify a row; the salt is a hash of them, so a retried task gives
    the same salt.  ``how`` is one of the joins that may repeat the right side: inner, left, left_semi, left_anti.
    Keys with more than ``hot_rows`` rows in ``big`` are found by a count and split as far as needed; the table of hot
    keys has at most rows / hot_rows entries.  Where ``big`` is costly to compute twice, a plain join does: adaptive
    execution broadcasts a small side and splits skewed partitions.
    """
    keys = list(keys)
    hot = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    )
    one = F.coalesce(F.col("_salts"), F.lit(1))
    salt = F.pmod(F.xxhash64(*spread), one).cast("int")
    left = big.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    right = (
        small.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1)))
        .drop("_salts")
    )
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that no guess of its size broadcasts.

    The planner's estimate takes no account of the rows that ``explode`` adds, so a small table unfolded many times would
    be gathered whole on the driver; adaptive execution cannot take that back.
    """
    return df.hint("merge")


def pick_rank(df: DataFrame, keys: Sequence[str], value: str, rank: Column, out: str, buckets: int = 1024) -> DataFrame:
    """Exact order statistic per group: the element at 0-based ``rank`` of the ascending values.

    ``rank`` may use the column ``n``, the group's size.  Values are counted before they are ranked, and only the
    value bucket holding the rank is sorted, so no group is gathered whole.  Returns keys, n and ``out``.
    """
    if not keys:
        return pick_rank(df.withColumn("_all", F.lit(0)), ["_all"], value, rank, out, buckets).drop("_all")
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    stats = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("n"))
    stats = stats.withColumn("_rank", F.greatest(F.lit(0), F.least(rank.cast("bigint"), F.col("n") - 1)))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    bucket = F.floor((F.col("_v") - F.col("_lo")) / span * buckets)
    placed = counts.join(stats, keys).withColumn("_b", bucket)
    per_bucket = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"), F.max("_rank").alias("_rank"))
    upto = Window.partitionBy(*keys).orderBy("_b")
    chosen = (
        per_bucket.withColumn("_cum", F.sum("_bc").over(upto))
        .where((F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_bc") <= F.col("_rank")))
        .select(*keys, "_b", (F.col("_cum") - F.col("_bc")).alias("_before"))
    )
    inside = placed.join(chosen, keys + ["_b"])
    within = Window.partitionBy(*keys).orderBy("_v")
    return (
        inside.withColumn("_cum", F.sum("_c").over(within) + F.col("_before"))
        .where((F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_c") <= F.col("_rank")))
        .select(*keys, "n", F.col("_v").alias(out))
    )


def prev_known(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, out: str, forward: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Last non-null ``value`` before each row (or next after it, with ``forward``) along ``order`` within ``keys``.

    ``bucket`` must not decrease along ``order``.  Each (keys, bucket) is one window, and what earlier buckets hold
    comes from one row per bucket, so a hot key is spread over its buckets.  ``strict`` leaves the row itself out.
    """
    keys, order = list(keys), list(order)
    df = df.withColumn("_b", bucket).withColumn("_v", value)
    asc = [F.desc(c) if forward else F.asc(c) for c in order]
    edge = -1 if strict else 0
    inner = Window.partitionBy(*keys, "_b").orderBy(*asc).rowsBetween(Window.unboundedPreceding, edge)
    pick = F.min_by if forward else F.max_by
    at = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = df.groupBy(*keys, "_b").agg(pick("_v", at).alias("_end"))
    outer = Window.partitionBy(*keys).orderBy(F.desc("_b") if forward else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.last("_end", True).over(outer)).select(*keys, "_b", "_carry")
    local = df.withColumn("_l", F.last("_v", True).over(inner))
    return local.join(ends, [*keys, "_b"]).withColumn(out, F.coalesce("_l", "_carry")).drop("_b", "_v", "_l", "_carry")


def dense_position(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position along ``order`` within ``keys``, ranked inside buckets and shifted by the buckets before."""
    keys = list(keys)
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(local)).join(sizes, [*keys, "_b"])
    return ranked.withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop("_rn", "_off", "_b")


def pieces(df: DataFrame, keys: Sequence[str], pos: str, size: int, halo: int) -> DataFrame:
    """Cut each key's rows (dense ``pos`` from 1) into pieces, the last ``halo`` rows repeated at the next piece's head.

    Adds ``piece`` and ``is_halo``; windows of up to ``halo`` rows back can then run per (keys, piece).
    """
    own = F.floor((F.col(pos) - 1) / size).cast("bigint")
    nxt = F.floor((F.col(pos) - 1 + halo) / size).cast("bigint")
    both = df.withColumn("piece", F.explode(F.array_distinct(F.array(own, nxt))))
    return both.withColumn("is_halo", F.col("piece") != own)
