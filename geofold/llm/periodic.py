"""Periodic runs of words by recompression: block and pair compression in turns give a run-length grammar, whose common-extension
queries answer exactly how far a candidate of the harmonic grid reaches to both sides.

The words of many texts are compressed together, with a letter of its own between texts that no rule takes.  A level
is either a block step (each maximal block of one letter becomes a letter) or a pair step (letters are divided in left
and right ones, each pair of a left and a right one becomes a letter).  Both look at a letter and its neighbour
alone, so equal stretches are compressed alike but for their rims: an extension climbs the levels while both places
begin a rule, and comes down where letters differ, with a constant number of steps a level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, remembered

#: A run has at least this many words, and its period at least twice.
LEAST = 12
#: Words compressed together (one longer text is by itself), candidates extended at once.
WORDS, CANDIDATES = 150_000, 300_000
#: Texts up to this length take their candidates from one table.
TABLE = 4096


class Level(NamedTuple):
    """Letters, and how they go into the next level: the rule each is in, each rule's first letter (and the end), the kind of step."""

    letters: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    block: bool


def _named(keys: np.ndarray, free: int) -> tuple[np.ndarray, int]:
    """New letters from ``free`` on for equal keys, and the next free one."""
    found, at = np.unique(keys, return_inverse=True)
    return free + at, free + len(found)


def recompress(letters: np.ndarray, walls: np.ndarray) -> list[Level]:
    """Levels of the grammar; ``walls`` marks letters that stand once and stay by themselves."""
    s, free, levels, seed = letters.astype(np.int64), int(letters.max(initial=0)) + 1, [], 0
    wall = np.zeros(free, bool)
    wall[s[walls]] = True

    def into(heads: np.ndarray, block: bool) -> None:
        begins = np.zeros(len(s), bool)
        begins[heads] = True
        levels.append(Level(s.astype(np.int32), (np.cumsum(begins) - 1).astype(np.int32), np.append(heads, len(s)).astype(np.int32), block))

    while True:
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        if len(heads) < len(s):
            times = np.diff(np.append(heads, len(s)))
            many = times > 1
            into(heads, True)
            s = s[heads]
            s[many], free = _named(s[many] * (int(times.max()) + 1) + times[many], free)
        stays = np.zeros(len(s), bool)
        low = s < len(wall)
        stays[low] = wall[s[low]]
        if not (~stays[1:] & ~stays[:-1]).any():
            break
        pairs = np.zeros(0, np.int64)
        while not len(pairs):  # a quarter of all pairs are expected
            seed += 1
            side = ((s.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(1) == 1
            pairs = np.flatnonzero(~side[:-1] & side[1:] & ~stays[:-1] & ~stays[1:])
        keep = np.ones(len(s), bool)
        keep[pairs + 1] = False
        names, after = _named(s[pairs] * free + s[pairs + 1], free)
        into(np.flatnonzero(keep), False)
        s[pairs], free = names, after
        s = s[keep]
    levels.append(Level(s.astype(np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), False))
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the reversed words."""
    return [Level(x.letters[::-1], (len(x.first) - 2 - x.parent[::-1]) if len(x.first) else x.parent, (len(x.letters) - x.first[::-1]) if len(x.first) else x.first, x.block) for x in levels]


def extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For places x, y of the words: how many words from there on are equal.  Both must end at different walls or one before the other."""
    i, j = x.astype(np.int64), y.astype(np.int64)
    differ = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k, (s, parent, first, block) in enumerate(levels):
        up = []
        while len(live):
            a, b = i[live], j[live]
            same = s[a] == s[b]
            differ[live[~same]] = k
            live, a, b = live[same], a[same], b[same]
            if k + 1 == len(levels):
                i[live], j[live] = a + 1, b + 1
                continue
            p, q = parent[a], parent[b]
            both = (first[p] == a) & (first[q] == b)
            i[live[both]], j[live[both]] = p[both], q[both]
            up.append(live[both])
            live, a, b, p, q = (v[~both] for v in (live, a, b, p, q))
            step = np.minimum(first[p + 1] - a, first[q + 1] - b) if block else 1
            i[live], j[live] = a + step, b + step
        live = np.concatenate(up) if up else live
    for k in range(len(levels) - 2, -1, -1):
        s, parent, first, block = levels[k]
        down = np.flatnonzero(differ > k)
        a, b = first[i[down]].astype(np.int64), first[j[down]].astype(np.int64)
        same = s[a] == s[b]
        step = np.minimum(first[parent[a] + 1] - a, first[parent[b] + 1] - b) if block else 1
        i[down], j[down] = a + same * step, b + same * step
    return i - x


def _spacing(p: np.ndarray) -> np.ndarray:
    """Words p apart are equal in a stretch of at least this length, if they are in a run."""
    return np.maximum(p, LEAST - p)


def _grid(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates (place, place + period) of periods from ``low`` to below ``high`` in n words."""
    p = np.arange(low, high)
    step = _spacing(p)
    count = -(-(n - p) // step)
    period = np.repeat(p, count)
    number = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    place = number * np.repeat(step, count)
    return place, place + period


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of a text of ``TABLE`` words in the order of their end, and how many lie in each shorter text."""
    a, b = _grid(TABLE, 1, TABLE // 2 + 1)
    order = np.argsort(b, kind="stable")
    return a[order].astype(np.int32), b[order].astype(np.int32), np.searchsorted(b[order], np.arange(TABLE + 1))


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, in this order; ``words`` are the numbers of all texts end to end."""
    top, many = int(words.max(initial=0)) + 1, len(sizes)
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes  # place of each text's first word; a wall stands before each text and at the end
    letters = np.empty(len(words) + many + 1, np.int64)
    walls = np.concatenate([begin - 1, [len(letters) - 1]])
    letters[walls] = top + np.arange(many + 1)
    inside = np.ones(len(letters), bool)
    inside[walls] = False
    letters[inside] = words
    levels = recompress(letters, walls)
    back = mirrored(levels)
    found, waiting, held = [], [], 0

    def extend(x: np.ndarray, y: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        right = extension(levels, x, y)
        left = extension(back, len(letters) - x, len(letters) - y)
        period, start = y - x, x - left
        length = period + left + right
        ok = (left + right >= period) & (length >= LEAST)
        out = (text[ok], start[ok] - begin[text[ok]], length[ok], period[ok])
        found.append(out)
        return out

    def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(letters[x] == letters[y])  # a stretch has six words at least, so a neighbour, too
        x, y = x[at], y[at]
        return at[(letters[x + 1] == letters[y + 1]) | (letters[x - 1] == letters[y - 1])]

    a, b, cut = remembered("candidates of periods", _table)
    for t in range(many):
        n, o = int(sizes[t]), int(begin[t])
        if n < LEAST:
            continue
        if n <= TABLE:
            x, y = a[:cut[n]] + o, b[:cut[n]] + o
            at = equal(x, y)
            if len(at):
                waiting.append((x[at], y[at], np.full(len(at), t)))
                held += len(at)
            if held > CANDIDATES:
                extend(*map(np.concatenate, zip(*waiting)))
                waiting, held = [], 0
            continue
        # In the part of a run known already, candidates of multiples of its period tell nothing new.
        root, until = np.ones(n, np.int64), np.zeros(n, np.int64)
        p = np.arange(1, n // 2 + 1)
        total = np.cumsum(-(-(n - p) // _spacing(p)))
        low = 1
        while low <= n // 2:
            done = int(total[low - 2]) if low > 1 else 0
            high = max(low + 1, int(np.searchsorted(total, done + CANDIDATES, side="right")) + 1)
            x, y = _grid(n, low, min(high, n // 2 + 1))
            low = high
            known = (y < until[x]) & ((y - x) % root[x] == 0)
            x, y = x[~known] + o, y[~known] + o
            at = equal(x, y)
            _, start, length, period = extend(x[at], y[at], np.full(len(at), t))
            new = np.unique(np.stack([start, length, period]), axis=1)
            for s, m, q in new[:, (new[1] >= 3 * new[2]) & (new[1] >= TABLE)].T.tolist():
                wider = until[s:s + m] < s + m
                until[s:s + m][wider], root[s:s + m][wider] = s + m, q
    if waiting:
        extend(*map(np.concatenate, zip(*waiting)))
    text, start, length, period = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (v[order] for v in (text, start, length, period))
    new = np.ones(len(text), bool)  # of one stretch, the smallest period
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = (v[new] for v in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", order: Callable[[int, int], np.ndarray] | None = None) -> DataFrame:
    """key, ``n_words``, ``runs`` (array of start, length, period by start, then period) and ``collapsed`` of each whole text.

    Words are stretches of anything but ASCII white space, numbered from 0.  A run is a stretch of at least ``LEAST``
    words and twice its smallest period that no neighbouring word extends.  ``collapsed`` is the words outside the
    repetitions (those after a run's first period), joined by a space.  ``order`` may give, for a key and a number of
    words, the places of the words to be read instead; a null key's words are read as they are.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Rows stay rows whatever their key, and equal
    rows get equal results; other columns are not read; an empty table gives an empty result.  One text is one task's
    work, in memory that grows with its words; no rows are shuffled.
    """
    df = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("_id", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def work(ids: pa.Array, lists: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        words = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in lists for w in ws), np.int64, int(sizes.sum()))
        t, start, length, period = find_runs(words, sizes)
        begin = np.cumsum(sizes) - sizes
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, begin[t] + start + period, 1)
        np.add.at(depth, begin[t] + start + length, -1)
        gone = np.cumsum(depth)[:-1] > 0
        having = set(t.tolist())
        left = []
        for k, ws in enumerate(lists):
            if k in having:
                lost = gone[begin[k]:begin[k] + sizes[k]].tolist()
                ws = [w for w, g in zip(ws, lost) if not g]
            left.append(b" ".join(ws).decode())
        bounds = pa.array(np.searchsorted(t, np.arange(len(lists) + 1)).astype("i4"))
        runs = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in (start, length, period)], ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), runs, pa.array(left, pa.string())], schema.names)

    def tell(cols) -> Iterator[pa.RecordBatch]:
        texts, lo, lists, held = cols["_text"], 0, [], 0
        for i in range(len(texts)):
            ws = texts[i].as_py().encode().split() if texts[i].is_valid else []
            ident = cols["_id"][i].as_py()
            if order is not None and ws and ident is not None:
                at = order(ident, len(ws))
                ws = ws if at is None else [ws[k] for k in at.tolist()]
            if lists and held + len(ws) > WORDS:
                yield work(cols["_id"].slice(lo, len(lists)), lists)
                lo, lists, held = i, [], 0
            lists.append(ws)
            held += len(ws)
        if lists:
            yield work(cols["_id"].slice(lo, len(lists)), lists)

    return batches(df, tell, schema).withColumnRenamed("_id", key)


def planted(key: int, n: int) -> np.ndarray | None:
    """The words of one text in ten repeat from some place on: places of the words to be read for it."""
    import zlib

    h = zlib.crc32(str(key).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", order: Callable[[int, int], np.ndarray] | None = planted) -> DataFrame:
    """key, ``n_runs``, the longest run (ties: smallest start, then period; nulls if none) and digests of all runs and of what is left."""
    rows = detect(docs, key, text, order)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("_l"), r["start"].alias("_s"), r["period"].alias("_p"))))

    def line(r: Column) -> Column:
        return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))

    rows = rows.withColumn("_best", best)
    length = -F.col("_best._l")
    return rows.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("_best._s").alias("start"), length.alias("length"), F.col("_best._p").alias("period"),
        F.floor(1000 * length / F.col("_best._p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
