"""Packing token pieces into fixed windows: non-negative least squares over shallow length combinations, greedy residuals."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, remembered, stored

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Distinct words whose ids a worker remembers; beyond it words are encoded each time.
REMEMBERED = 400_000


class Encoder(dict):
    """Ids of a space-free run of lower-case characters as bytes, by the public tokenizer; remembers a bounded number.

    The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are its runs' ids.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for one run of letters, which needs no splitting
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def __missing__(self, run: str) -> bytes:
        word = run.rstrip(".,")
        if word != run and word and word.isalpha():  # a stop after a word is a piece of its own
            return self[word] + self[run[len(word):]]
        tokenizer = self.plain if word == run and word.isalpha() else self.whole
        ids = np.asarray(tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < REMEMBERED and len(run) < 40:
            self[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # the tokenizer lowers each character by itself
        return b"".join(map(self.__getitem__, text.split()))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Token pieces of each document: as many whole windows as it fills, then the rest.

    Columns key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if wanted, ``ids``.  A null text is empty;
    an empty one is the end id alone.  Rows stay rows whatever their key; other columns are not read.
    """
    df = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    name = tokenizer  # a path, or by default looked up where the task runs

    def cut(cols) -> Iterator[pa.RecordBatch]:
        path = name or tokenizer_path()
        encode = remembered("encoder", lambda: Encoder(path), path).encode
        end = np.asarray([END], "<u4").tobytes()
        rows, start, length, crc, total, ids = [], [], [], [], [], []

        def batch():
            arrays = [cols["_id"].take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
            arrays += [pa.array([np.frombuffer(x, "<u4").astype("i4") for x in ids], pa.list_(pa.int32()))] if keep_ids else []
            return pa.RecordBatch.from_arrays(arrays, ["_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids)

        held = 0
        for i, t in enumerate(cols["_text"]):
            data = (encode(t.as_py()) if t.is_valid else b"") + end
            for lo in range(0, len(data), 4 * window):
                part = data[lo:lo + 4 * window]
                rows.append(i)
                start.append(lo // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(len(data) // 4)
                if keep_ids:
                    ids.append(part)
                    held += len(part)
            if held > 8 << 20:
                yield batch()
                for x in (rows, start, length, crc, total, ids):
                    x.clear()
                held = 0
        if rows:
            yield batch()

    schema = f"_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * keep_ids
    return batches(df, cut, schema).withColumnRenamed("_id", key)


def combinations(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with one, two or three lengths, each in falling order."""
    found = [(units,)] + [(units - b, b) for b in range(1, units // 2 + 1)]
    for c in range(1, units // 3 + 1):
        found += [(units - b - c, b, c) for b in range(c, (units - c) // 2 + 1)]
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |a x - b| by the active-set method: free the steepest variable, step back to the border."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= tolerance:
            break
        free[best] = True
        while True:
            step = np.zeros_like(x)
            step[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (step <= 0)
            if not low.any():
                x = step
                break
            part = float((x[low] / np.maximum(x[low] - step[low], 1e-300)).min())
            x = x + part * (step - x)
            free &= x > tolerance
            x[~free] = 0.0
            if not free.any():
                break
    return x


def solve(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(combination of lengths, times) that use each length exactly as often as ``histogram[length - 1]`` says."""
    units, left, out = len(histogram), histogram.astype(np.int64).copy(), []
    ways = combinations(units)
    present = [w for w in ways if all(left[x - 1] for x in w)]
    if present:
        a = np.zeros((units, len(present)))
        for j, w in enumerate(present):
            for x in w:
                a[x - 1, j] += 1
        for w, times in zip(present, np.floor(nnls(a, left.astype(float)) + 1e-6).astype(np.int64)):
            need = {x: w.count(x) for x in w}
            times = min([int(times), *(int(left[x - 1]) // m for x, m in need.items())])
            if times > 0:
                out.append((w, times))
                for x, m in need.items():
                    left[x - 1] -= m * times
    while left.any():  # what rounding left: the longest that still fits, repeatedly
        room, way, have = units, [], left.copy()
        while room and (fit := np.flatnonzero(have[:room])).size:
            x = int(fit[-1]) + 1
            many = min(room // x, int(have[x - 1]))
            way += [x] * many
            have[x - 1] -= many
            room -= many * x
        times = min(int(left[x - 1]) // way.count(x) for x in set(way))
        out.append((tuple(way), times))
        for x in set(way):
            left[x - 1] -= way.count(x) * times
    return out


def pack(found: DataFrame, key: str = "doc_id", window: int = 4096, unit: int = 16, bucket_rows: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces``: at most ``window`` tokens a sequence, no gaps inside one.

    Lengths are rounded up to ``unit`` tokens for the plan alone.  The histogram has window / unit bins and the plan
    a few combinations a bin, so both stay small at any input; pieces find their place by their rank within a bin,
    which is counted per hash bucket, so a length that many documents share is ranked in many tasks.  Pieces of equal
    length, key and start are interchangeable.  An empty table gives an empty result.
    """
    spark = found.sparkSession
    units = -(-window // unit)
    df = found.withColumn("_bin", F.ceil(F.col("length") / unit).cast("int"))
    buckets = max(1, -(-df.count() // bucket_rows))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key, "start"), F.lit(buckets)))
    counts = df.groupBy("_bin", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_bin").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    histogram = np.zeros(units, np.int64)
    for r in counts.groupBy("_bin").agg(F.sum("_n").alias("n")).collect():  # one row a bin
        histogram[r["_bin"] - 1] = r["n"]
    slots, used, first = [], dict.fromkeys(range(1, units + 1), 0), 0
    for way, times in solve(histogram):
        for x in sorted(set(way), reverse=True):
            m = way.count(x)
            slots.append((x, used[x], used[x] + m * times, m, first))
            used[x] += m * times
        first += times
    slots = spark.createDataFrame(slots or [(0, 0, 0, 1, 0)], "_bin int, _lo bigint, _hi bigint, _m bigint, _first bigint")
    ranked = df.withColumn("_row", F.row_number().over(Window.partitionBy("_bin", "_bucket").orderBy(F.col(key).asc_nulls_first(), "start")) - 1)
    ranked = ranked.join(counts.drop("_n"), ["_bin", "_bucket"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    # At most a few combinations a bin: a table of some thousand rows.
    placed = ranked.join(F.broadcast(slots), "_bin").where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_m")))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("_bin").desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.select(*found.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, key, text, window, tokenizer, keep_ids)), key, window)
