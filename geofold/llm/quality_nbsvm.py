"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, and a linear hinge-loss model on them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fold, free_name, remembered

#: Hashed features; the model is one number each.
SPACE = 1 << 18
#: Labelled rows the model is fitted on, at most, of each class: those with the smallest hashes.
SAMPLE = 6_000
SHARES = (0.02, 0.1, 0.3)
TOKEN = re.compile(r"[A-Z]{2,}|[A-Z]?[^\W\d_A-Z]+|[^\W\d_]+|\d+|[^\w\s]+|_+|\n")


class Codes(dict):
    """A token's 32-bit code; common ones are remembered, up to a bound."""

    def __missing__(self, token: str) -> int:
        c = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        if len(self) < 400_000 and len(token) < 40:
            self[token] = c
        return c


def features(text: str, space: int = SPACE) -> np.ndarray:
    """Sorted distinct feature numbers of a text: its words and marks, pairs of them, and how many pairs are a word twice.

    The first numbers stand for the shares of such pairs in ``SHARES``, as a word that is said over and over is a pair
    no training text may have had.
    """
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32)
    c = np.fromiter(map(remembered("token codes", Codes, 1).__getitem__, tokens), np.uint64, len(tokens))
    parts = [c * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)]
    if len(c) > 1:
        parts.append((c[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[1:] * np.uint64(0x165667B19E3779F9)))
    h = np.concatenate(parts)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    found = (h >> np.uint64(40)).astype(np.int64) % (space - len(SHARES)) + len(SHARES)
    same = float((c[1:] == c[:-1]).mean()) if len(c) > 1 else 0.0
    return np.unique(np.concatenate([found, [i for i, share in enumerate(SHARES) if same > share]])).astype(np.int32)


@dataclass
class Model:
    """``weights`` already hold the log-count ratios; ``slope`` and ``shift`` turn the margin into a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, x: np.ndarray) -> float:
        """The mean over a text's features, so long texts are judged like short ones."""
        return float(self.weights[x].sum() / np.sqrt(max(len(x), 1))) + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text or "")) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def ratios(rows: list[np.ndarray], y: np.ndarray, space: int = SPACE, smooth: float = 1.0) -> np.ndarray:
    """log of (smoothed share of a feature among the good) / (among the bad), by documents that have it."""
    counts = {s: np.full(space, smooth) for s in (1, -1)}
    for x, s in zip(rows, y):
        counts[int(s)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def fit_hinge(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model by dual coordinate descent, one document's multiplier at a time, in seeded order.

    A document's values are the ratios of its features over the root of their number; the bias is one more feature.
    Classes get equal total cost.  Stops when no projected gradient is left above 0.01.
    """
    values = [scale[x] / np.sqrt(max(len(x), 1)) for x in rows]
    square = np.array([float(v @ v) + 1.0 for v in values])
    upper = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    w, bias, alpha, rng = np.zeros_like(scale), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (float(w[x] @ v) + bias) - 1.0
            projected = min(slope, 0.0) if alpha[i] == 0 else max(slope, 0.0) if alpha[i] == upper[i] else slope
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
        if worst < 0.01:
            break
    return w * scale, bias


def fit(rows: list[np.ndarray], y: np.ndarray, space: int = SPACE) -> Model:
    """Ratios, hinge model and a logistic curve through held-back margins (a fifth of the rows, seeded)."""
    if len(rows) == 0 or len(set(y.tolist())) < 2:  # nothing to tell apart: the share of good rows
        share = float((y > 0).mean()) if len(rows) else 0.5
        return Model(np.zeros(space), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    held = np.random.default_rng(3).permutation(len(rows)) % 5 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    train = np.flatnonzero(~held)
    scale = ratios([rows[i] for i in train], y[train], space)
    w, bias = fit_hinge([rows[i] for i in train], scale, y[train])
    at = np.flatnonzero(held) if held.any() else train
    m = Model(w, bias, 1.0, 0.0)
    z, t = np.array([m.margin(rows[i]) for i in at]), (y[at] > 0).astype(float)
    good, bad = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's method on two numbers
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        g = np.array([((p - t) * z).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        hess = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(w, bias, max(a, 1e-3), b)


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, keep, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of at most ``sample`` labelled rows a class, chosen by hash, counted where the texts are.

    Only feature numbers reach the driver: for 2 x 6000 rows of a thousand features some 50 MB, and at most the whole
    space a row.  Rows that say the same and have equal texts count once each.
    """
    of = free_name(docs, "_of")
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias(of)).agg(F.max(label).alias("_y"))
    marks = marks.where(keep(F.col(of)))
    order = F.xxhash64(of, F.lit(11))
    chosen = marks.where("_y = 1").orderBy(order, of).limit(sample).unionByName(marks.where("_y = 0").orderBy(order, of).limit(sample))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).join(F.broadcast(chosen), F.col("_id") == F.col(of)).select("_t", F.col("_y").cast("int"))

    def count(cols) -> Iterator[pa.RecordBatch]:
        found = [features(x.as_py()).tobytes() for x in cols["_t"]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), cols["_y"]], ["x", "y"])

    got = batches(rows, count, "x binary, y int").orderBy("x", "y").toArrow()
    y = np.where(np.asarray(got["y"]) == 1, 1.0, -1.0) if got.num_rows else np.zeros(0)
    return [np.frombuffer(x.as_py(), np.int32) for x in got["x"]], y


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``score`` (0 to 1, higher: label 1 likelier) of every whole text; a null text counts as empty."""
    df = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_t"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.slope, model.shift))  # 1 MB

    def rate(cols) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        yield pa.RecordBatch.from_arrays([cols["_id"], pa.array([m.score(x.as_py()) for x in cols["_t"]], pa.float64())], ["_id", "score"])

    return batches(df, rate, f"_id {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("_id", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, cutoff: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """key, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Labels are learned from rows outside fold 0 (crc32 of the key's text modulo ``folds``).  A key labelled twice
    counts once, with its largest label; null keys and labels other than 0 and 1 teach nothing.  Repeated rows score
    alike; without both labels every score is the share of good rows; an empty table gives an empty result.
    """
    keep = lambda c: fold(c, folds) != 0
    model = fit(*training_rows(docs, labels, key, text, label, keep, sample))
    out = score(docs, model, key, text)
    return out.select(key, (fold(F.col(key), folds) == 0).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
