"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, per shard, then seeded block selection."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, batches, free_name, stored

#: A prime above any number of blocks in a shard, so multiplying by it permutes the block numbers.
STEP = 1_000_000_007


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(df: DataFrame, by: Sequence[str], votes: str, total: str, tie: Sequence[str], out: str) -> DataFrame:
    """Give ``total`` seats of each group ``by`` to its rows by the highest quotients votes / (2 j - 1).

    Two divisors bracket the result, so only about three candidate seats a row are ranked.  Ties of quotients go by
    ``tie``, which must identify a row within its group.  Groups without votes get no seat.
    """
    w, rest = Window.partitionBy(*by), [c for c in df.columns if c not in by and c not in tie]
    v, q = F.col(votes).cast("double"), F.greatest(F.col(total), F.lit(0))
    df = df.withColumn("_sum", F.sum(v).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    share = F.when(F.col("_sum") > 0, v / F.col("_sum")).otherwise(0.0)
    df = df.withColumn("_least", F.floor(share * F.greatest(q - F.col("_n") / 2, F.lit(0)) + 0.5 - 1e-9))
    df = df.withColumn("_least", F.when(q > F.col("_n") / 2, F.greatest("_least", F.lit(0))).otherwise(0))
    df = df.withColumn("_most", F.when(F.col("_sum") > 0, F.floor(share * (q + F.col("_n") / 2) + 0.5) + 1).otherwise(F.col("_least")))
    df = df.withColumn("_left", q - F.sum("_least").over(w))
    seat = F.explode_outer(F.when(F.col("_most") > F.col("_least"), F.sequence(F.col("_least") + 1, F.col("_most"))))
    df = df.withColumn("_j", seat).withColumn("_quotient", v / (2 * F.col("_j") - 1))
    order = [F.col("_quotient").desc_nulls_last(), *tie, "_j"]
    df = df.withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    won = F.sum(F.when(F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    df = df.groupBy(*by, *tie).agg(*[F.first(c).alias(c) for c in rest], F.first("_least").alias("_least"), won.alias("_won"))
    return df.withColumn(out, (F.col("_least") + F.col("_won")).cast("long")).drop("_least", "_won")


def targets(sources: DataFrame, size: str, order: str, weights: Sequence[float], cap: float) -> DataFrame:
    """Add ``target``: the total size shared by repeating ``weights``, none above ``cap`` times its size.

    Sorted by the level at which a source meets its cap, a source is capped if the level that is left for it and all
    later ones lies above; the first that is not sets the level of the rest.  One row per source, so one window.
    """
    one = Window.partitionBy(F.lit(1))
    number = F.row_number().over(one.orderBy(F.col(order).asc_nulls_last())) - 1
    df = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (number % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col(size) * float(cap)).withColumn("_meets", F.col("_cap") / F.col("_w"))
    before = one.orderBy("_meets", F.col(order).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(size).over(one) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    df = df.withColumn("_level", left / (F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    df = df.withColumn("_rest", F.min_by(F.when(F.col("_meets") > F.col("_level"), F.col("_level")), F.when(F.col("_meets") > F.col("_level"), F.col("_meets"))).over(one))
    open_ = F.coalesce(F.col("_meets") > F.col("_level"), F.lit(False))
    df = df.withColumn("target", F.when(open_, F.col("_w") * F.col("_rest")).otherwise(F.col("_cap")))
    return df.drop("_w", "_cap", "_meets", "_level", "_rest")


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (1, 2, 3),
    cap: int = 3, unit: int = 1, block: int = 64, shard_words: int = 2_000_000, seed: int = 7,
) -> DataFrame:
    """Choose what a mix takes of each document; one row per row of ``docs``.

    Columns: key, ``size`` (words), ``source_size``, ``target``, ``rounds`` (times the whole document is taken),
    ``ranges`` (word ranges taken once more) and ``taken``.  Documents are dealt to shards by hash, laid end to end in
    a seeded order per source and shard, and cut into blocks of ``block`` words.  Quotas of ``unit`` words go to sources,
    then to the shards of a source, by highest quotients, so that with single words even a source of a few words gets its
    share; a quota is met by whole rounds and a seeded choice of blocks, the last of them cut where the quota ends.

    Null or empty texts have size 0 and nothing is taken.  Null sources are one source, sorted last.  A null key or
    repeated rows are documents of their own; equal rows share a place in the order, so swapping them changes nothing.
    An empty table gives an empty result.  Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    sizes = stored(docs.select(
        F.col(key).alias("_id"), F.col(source).cast("string").alias("_name"), src.alias("_src"),
        word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(seed)).alias("_order"),
    ))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    sizes = sizes.withColumn("_shard", F.pmod(F.xxhash64("_order", F.lit(seed + 1)), F.lit(shards)))
    by_source = targets(sizes.groupBy("_src", "_name").agg(F.sum("size").alias("source_size")), "source_size", "_name", weights, cap)
    by_source = by_source.withColumn("_units", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / unit).cast("long")).withColumn("_all", F.lit(1))
    by_source = sainte_lague(by_source, ["_all"], "target", "_units", ["_src"], "_quota").select("_src", "source_size", "target", "_quota")
    by_shard = sizes.groupBy("_src", "_shard").agg(F.sum("size").alias("_votes")).join(by_source, "_src")
    by_shard = sainte_lague(by_shard, ["_src"], "_votes", "_quota", ["_shard"], "_seats")
    votes = F.col("_votes")
    words = F.least(F.col("_seats") * unit, votes * cap)
    by_shard = by_shard.select(
        "_src", "_shard", "source_size", "target", F.floor(votes / block).alias("_full"),
        F.when(votes > 0, F.floor(words / votes)).otherwise(0).alias("rounds"), F.when(votes > 0, words % votes).otherwise(0).alias("_more"),
        F.pmod(F.xxhash64("_src", "_shard", F.lit(seed + 2)), F.lit(STEP)).alias("_shift"),
    )
    w = Window.partitionBy("_src", "_shard").orderBy("_order", F.col("_id").asc_nulls_first())
    laid = sizes.withColumn("_end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("_start", F.col("_end") - F.col("size")).join(by_shard, ["_src", "_shard"])
    # Full blocks in their seeded order, the last of them in part; the short block at the end comes after all others.
    rank = lambda b: F.when(b < F.col("_full"), F.pmod(b * STEP + F.col("_shift"), F.col("_full"))).otherwise(b)
    taken = lambda b: F.greatest(F.lit(0), F.least(F.lit(block), F.col("_more") - rank(b) * block))
    blocks = F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block))
    ranges = F.filter(F.transform(blocks, lambda b: F.struct(
        F.greatest(b * block - F.col("_start"), F.lit(0)).alias("lo"), F.least(b * block + taken(b) - F.col("_start"), F.col("size")).alias("hi"),
    )), lambda r: r["hi"] > r["lo"])
    laid = laid.withColumn("ranges", F.when((F.col("size") > 0) & (F.col("_more") > 0), ranges).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
    once = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])
    return laid.select(
        F.col("_id").alias(key), "size", "source_size", F.col("target").cast("double").alias("target"), F.col("rounds").cast("long").alias("rounds"),
        "ranges", (F.col("rounds") * F.col("size") + once).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix as documents: whole copies, and one more row with the text of the word ranges that are taken once more.

    Columns are those of ``docs``.  A document that is taken whole is unchanged; the ranges of a cut one are joined by
    a line break.  Rows with no word stay, as they cost nothing.  A repeated row is mixed as often as it stands there.
    """
    took, size, rounds, ranges = (free_name(docs, c) for c in ("_took", "_size", "_rounds", "_ranges"))
    number = free_name(docs, "_number")
    plan = mix(docs, key=key, text=text, **options)
    plan = plan.groupBy(F.col(key).alias(took)).agg(
        F.max("size").alias(size), F.sum("rounds").alias(rounds), F.flatten(F.collect_list("ranges")).alias(ranges), F.count(F.lit(1)).alias(number))
    # Rows with one key are rare (copies of a row); their shares are dealt evenly among them.
    rows = docs.join(plan, docs[key].eqNullSafe(plan[took]))
    whole = rows.where((F.col(rounds) > 0) | (F.col(size) == 0)).withColumn(
        number, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col(rounds) / F.col(number))).cast("int")))).select(*docs.columns)
    names = docs.columns

    def cut(cols) -> Iterator[pa.RecordBatch]:
        texts = pa.array([_cut(t.as_py(), r.as_py()) for t, r in zip(cols[text], cols[ranges])], pa.string())
        yield pa.RecordBatch.from_arrays([texts if n == text else cols[n] for n in names], names)

    return whole.unionByName(batches(rows.where(F.size(ranges) > 0).select(*names, ranges), cut, docs.schema))


def _cut(text: str, ranges) -> str:
    spans = [m.span() for m in re.finditer(WORD, text)]
    out, merged = [], []
    for r in sorted((int(r["lo"]), int(r["hi"])) for r in ranges):
        if merged and merged[-1][1] >= r[0]:
            merged[-1][1] = max(merged[-1][1], r[1])
        else:
            merged.append(list(r))
    if len(merged) == 1 and merged[0][0] == 0 and merged[0][1] >= len(spans):
        return text
    for lo, hi in merged:
        out.append(text[spans[lo][0]:spans[min(hi, len(spans)) - 1][1]])
    return "\n".join(out)
