"""Repeated byte strings by a distributed merge sort of suffixes: front-coded sorted runs, combined by loser trees with known prefixes.

Not every suffix is sorted.  Each window of ``LENGTH`` bytes has an anchor, the place of the smallest hash of ``SEED``
bytes inside it; equal windows have equal anchors, so it is enough to sort the suffixes at anchors, about one byte in
thirteen, each with the bytes before it that its windows may reach back to.  As in prefix-doubling sorts, the suffixes'
first ``SEED`` bytes are compared by fingerprint beforehand, and suffixes whose prefix no other document has leave.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, released, remembered, stored

LENGTH = 50
SEED = 26
#: Bytes before an anchor that a window with this anchor may reach; windows start 0 to BACK bytes before it.
BACK = LENGTH - SEED
#: Text of one sorted run, and of one step of the anchor search, in bytes.
RUN_BYTES, STEP_BYTES = 8 << 20, 1 << 20
#: Suffixes of one merge, about; fingerprints of one bucket, about.
MERGE, BUCKET = 150_000, 500_000
#: Bits of the filter of repeated fingerprints, at most (128 MB); past it more unique suffixes take part, nothing is lost.
FILTER_BITS = 1 << 30
FINGERPRINT = np.uint64(24)
NONE = -(1 << 63)
#: Mark of a document that goes whole.
WHOLE = -1


def _mixed(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``SEED`` bytes at every place (built from hashes of 2, 4, 8 and 16)."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    part, span = {1: h}, 1
    while span < 16:
        a = part[span]
        b = a[:-span] * np.uint64(0xBF58476D1CE4E5B9 + 2 * span) + (a[span:] ^ (a[span:] >> np.uint64(29)))
        span *= 2
        part[span] = b
    n = len(data) - SEED + 1
    out = part[16][:n] * np.uint64(0x94D049BB133111EB) + part[8][16:16 + n] * np.uint64(0xD6E8FEB86659FD93) + part[2][24:24 + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[:len(x) - (width - span)], x[width - span:]) if span < width else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors in documents laid end to end (``ends``: where each stops), and the hashes there."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _mixed(data)
    order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(order, BACK + 1, np.minimum)  # of the windows starting at each place
    for end in ends:  # no window crosses the end of a document
        least[max(0, end - LENGTH + 1):end] = 0
    padded = np.concatenate([np.zeros(BACK, np.uint32), least, np.zeros(BACK, np.uint32)])
    most = _slide(padded, BACK + 1, np.maximum)
    at = np.flatnonzero(order == most[:len(order)])
    return at, h[at]


class Chunk:
    """Documents of one run: id, text hash, bytes; anchors are looked for in steps as documents come."""

    def __init__(self):
        self.ids, self.hashes, self.texts, self.size = [], [], [], 0
        self.places, self.codes, self.owners = [], [], []
        self._from = 0

    def add(self, ident: int, code: int, text: bytes) -> None:
        self.ids.append(ident)
        self.hashes.append(code)
        self.texts.append(text)
        self.size += len(text)
        if sum(map(len, self.texts[self._from:])) >= STEP_BYTES if len(self.texts) % 64 == 0 or len(text) > STEP_BYTES else False:
            self.step()

    def step(self) -> None:
        texts = self.texts[self._from:]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        at, codes = anchors(data, ends)
        owner = np.searchsorted(ends, at, side="right")
        self.places.append((at - (ends - sizes)[owner]).astype(np.int32) if len(at) else at.astype(np.int32))
        self.codes.append(codes)
        self.owners.append((owner + self._from).astype(np.int32))
        self._from = len(self.texts)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._from < len(self.texts):
            self.step()
        parts = ((np.int32, self.places), (np.uint64, self.codes), (np.int32, self.owners))
        return tuple(np.concatenate([np.zeros(0, kind), *x]) for kind, x in parts)


def _chunks(it, make):
    chunk = Chunk()
    for b in it:
        ids, codes, texts = b.column(0), b.column(1).to_pylist(), b.column(2)
        for i, key in enumerate(ids.to_pylist()):
            text = texts[i].as_py() if texts[i].is_valid else b""
            if len(text) >= LENGTH:
                chunk.add(NONE if key is None else key, codes[i], text)
                if chunk.size >= RUN_BYTES:
                    yield from make(chunk)
                    chunk = Chunk()
    if chunk.texts:
        yield from make(chunk)


def _grouped(df: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """``applyInArrow`` over the groups of ``key``; ``fn`` gets the key's number and the group's other column as bytes."""
    groups: GroupedData = df.groupBy(key)

    def run(k: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return fn(k[0].as_py(), [x.as_py() for x in t.column(t.column_names[1])])

    return groups.applyInArrow(run, schema)


def _pack(values: np.ndarray, log: np.ndarray) -> bytes:
    """Sorted fingerprints as differences of as many bytes as the largest needs, and the logarithms of their counts."""
    steps = np.diff(values, prepend=values[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return values[:1].tobytes() + bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + log.tobytes()


def _unpack(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = run[8]
    n = (len(run) - 9) // (width + 1)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(run, np.uint8, n * width, 9).reshape(n, width)
    counts = np.left_shift(np.int64(1), np.frombuffer(run, np.uint8, n, 9 + n * width).astype(np.int64))
    return np.frombuffer(run, np.uint64, 1) + np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64), counts


def repeated(docs: DataFrame, buckets: int, hot: int) -> tuple[bytes, int, int, np.ndarray]:
    """(filter of fingerprints that two documents have, its blocks, suffixes that will pass, hot fingerprints).

    A run sends each of its fingerprints once, with the rough number of documents that have it.  The filter has a
    block of bits a bucket and is bounded; hot fingerprints (in over ``hot`` documents, or a millionth of all) are at
    most a million.
    """
    def send(it) -> Iterator[pa.RecordBatch]:
        remembered("nothing", None, 0)  # makes room

        def make(chunk: Chunk):
            _, codes, owners = chunk.found()
            pairs = np.unique(((codes >> FINGERPRINT) << np.uint64(20)) | owners.astype(np.uint64))
            values, counts = np.unique(pairs >> np.uint64(20), return_counts=True)
            log = np.ceil(np.log2(counts)).astype(np.uint8)
            cut = np.searchsorted(values, (np.arange(buckets + 1, dtype=np.float64) * (float(1 << 40) / buckets)).astype(np.uint64))
            rows = [(b, _pack(values[lo:hi], log[lo:hi])) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if hi > lo]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "run"])

        yield from _chunks(it, make)

    def meet(bucket: int, runs: list[bytes]) -> pa.Table:
        values, counts = zip(*map(_unpack, runs))
        v, c = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        total = np.add.reduceat(c, first)
        twice = total > 1
        v, total = v[first][twice], total[twice]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(v)], pa.int64()), "total": pa.array([int(total.sum())], pa.int64()),
                         "dups": pa.array([v.tobytes()], pa.binary()), "hot": pa.array([v[total > hot].tobytes()], pa.binary()), "docs": pa.array([total[total > hot].tobytes()], pa.binary())})

    met = stored(_grouped(docs.mapInArrow(send, "bucket int, run binary"), "bucket", meet, "bucket int, n bigint, total bigint, dups binary, hot binary, docs binary"))
    n, total = met.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    block = 64
    while block * buckets < 16 * n and block * buckets < FILTER_BITS:
        block *= 2

    def mark(cols) -> Iterator[pa.RecordBatch]:
        bits = []
        for x in cols["dups"]:
            at = np.zeros(block, np.uint8)
            for p in _probes(np.frombuffer(x.as_py(), np.uint64), block):
                at[p] = 1
            bits.append(np.packbits(at, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([cols["bucket"], pa.array(bits, pa.binary())], ["bucket", "bits"])

    blocks = batches(met.select("bucket", "dups"), mark, "bucket int, bits binary").toArrow()  # FILTER_BITS at most
    out = np.zeros((buckets, block // 8), np.uint8)
    for b, bits in zip(blocks["bucket"].to_pylist(), blocks["bits"]):
        out[b] = np.frombuffer(bits.as_buffer(), np.uint8)
    least = max(hot, total // 1_000_000)

    def hottest(cols) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(v.as_py(), np.uint64)[np.frombuffer(n.as_py(), np.int64) > least].tobytes() for v, n in zip(cols["hot"], cols["docs"])]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["hot"])

    top = batches(met.where(F.length("hot") > 0).select("hot", "docs"), hottest, "hot binary").toArrow()["hot"]  # a million at most
    hots = np.frombuffer(b"".join(x.as_py() for x in top), np.uint64)
    released(met)
    return out.tobytes(), block, total, np.sort(hots)


def _probes(v: np.ndarray, block: int):
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        yield ((v * np.uint64(k)) >> np.uint64(33)).astype(np.int64) & (block - 1)


def _passes(v: np.ndarray, bits: np.ndarray, buckets: int, block: int) -> np.ndarray:
    # The bucket is found as the sender found it: by comparison with the same borders.
    border = (np.arange(buckets + 1, dtype=np.float64) * (float(1 << 40) / buckets)).astype(np.uint64)
    bucket = np.searchsorted(border, v, side="right") - 1
    ok = np.ones(len(v), bool)
    for p in _probes(v, block):
        ok &= (bits[bucket * (block // 8) + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
    return ok


def _words(m: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, most significant first."""
    wide = -(-m.shape[1] // 8) * 8
    padded = np.zeros((len(m), wide), np.uint8)
    padded[:, :m.shape[1]] = m
    return list(padded.view(">u8").astype(np.uint64).T)


def _context(chunk: Chunk, place: np.ndarray, owner: np.ndarray):
    """Bytes from each anchor on, and those before it backwards, cut at the document's ends and filled with zeros."""
    sizes = np.fromiter(map(len, chunk.texts), np.int64, len(chunk.texts))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(chunk.texts) + bytes(LENGTH), np.uint8)
    at = starts[owner] + place
    rlen, llen = np.minimum(LENGTH, sizes[owner] - place), np.minimum(BACK, place)
    right, left = np.empty((len(at), LENGTH), np.uint8), np.empty((len(at), BACK), np.uint8)
    for lo in range(0, len(at), 20_000):  # place numbers take eight times the room of the bytes they fetch
        part = slice(lo, lo + 20_000)
        right[part] = data[at[part, None] + np.arange(LENGTH)]
        right[part][np.arange(LENGTH) >= rlen[part, None]] = 0
        left[part] = data[np.maximum(at[part, None] - 1 - np.arange(BACK), 0)]
        left[part][np.arange(BACK) >= llen[part, None]] = 0
    return right, rlen, left, llen


def _reach(rlen: np.ndarray, llen: np.ndarray) -> np.ndarray:
    """Bit o is set where a window can start o bytes before the anchor."""
    o = np.arange(BACK + 1)
    ok = (rlen[:, None] + o >= LENGTH) & (o <= llen[:, None])
    return (ok << o).sum(1).astype(np.int64)


def sorted_run(ids: np.ndarray, right, rlen, left, llen, place, owner) -> tuple[tuple, np.ndarray, np.ndarray]:
    """A run's suffixes in order, front-coded; the rows that a smaller document of the run settles; the order of the rest.

    Of equal suffixes with equal bytes before them only those of the smallest document stay: they answer for the rest.
    """
    doc = ids[owner]
    order = np.lexsort((place, doc, llen, *_words(left)[::-1], rlen, *_words(right)[::-1]))
    same = np.zeros(len(order), bool)
    r, x = right[order], left[order]
    same[1:] = (r[1:] == r[:-1]).all(1) & (x[1:] == x[:-1]).all(1) & (rlen[order][1:] == rlen[order][:-1]) & (llen[order][1:] == llen[order][:-1])
    group = np.cumsum(~same) - 1
    smallest = doc[order][np.flatnonzero(~same)][group] if len(order) else doc
    settled = doc[order] > smallest
    rest = order[~settled]
    r, n = right[rest], rlen[rest]
    differ = r[1:] != r[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), LENGTH)
    lcp = np.concatenate([[0], np.minimum(lcp, np.minimum(n[1:], n[:-1]))]).astype(np.uint8) if len(rest) else np.zeros(0, np.uint8)
    new = np.ones(len(rest), bool)
    new[1:] = (lcp[1:] < n[1:]) | (n[1:] != n[:-1])
    head = np.flatnonzero(new)
    tail = r[head][(np.arange(LENGTH) >= lcp[head][:, None]) & (np.arange(LENGTH) < n[head][:, None])].tobytes()
    return (lcp[head], n[head].astype(np.uint8), tail, np.diff(np.concatenate([head, [len(rest)]])).astype(np.uint32)), order[settled], rest


def _strings(lcp, rlen, tail: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(lcp.tolist(), rlen.tolist()):
        last = last[:k] + tail[at:at + n - k]
        at += n - k
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Loser tree over sorted runs of (strings, prefix each shares with the one before): run of each output, and its prefix
    shared with the output before.

    Every player carries the length it shares with the last output.  The longer one wins unread; only players with
    equal lengths compare bytes, and only past them.
    """
    count = len(runs)
    size = 1
    while size < count:
        size *= 2
    texts = [r[0] for r in runs] + [[]] * (size - count)
    known = [r[1] for r in runs] + [[]] * (size - count)
    at, n = [0] * size, [len(t) for t in texts]
    head = [t[0] if t else None for t in texts]
    share = [0 if t else -1 for t in texts]  # -1: the run has ended

    def play(a: int, b: int) -> tuple[int, int]:
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        if share[a] < 0:
            return a, b
        x, y, k = head[a], head[b], share[a]
        if x == y:
            win, lose, k = (a, b, len(x)) if a < b else (b, a, len(x))
        else:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[k:m], "big") ^ int.from_bytes(y[k:m], "big")
            k = m - (differ.bit_length() + 7) // 8
            win, lose = (a, b) if x < y else (b, a)
        share[lose] = k
        return win, lose

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    order, prefix = [], []
    while share[best] >= 0:
        order.append(best)
        prefix.append(share[best])
        at[best] += 1
        if at[best] < n[best]:
            head[best] = texts[best][at[best]]
            share[best] = known[best][at[best]]
        else:
            share[best] = -1
        node = (size + best) >> 1
        while node:
            other = losers[node]
            if share[best] < share[other]:
                losers[node], best = best, other
            elif share[best] == share[other] and share[best] >= 0:
                best, losers[node] = play(best, other)
            node >>= 1
    return np.array(order, np.int64), np.array(prefix, np.int64)


def settle(lcp: np.ndarray, new: np.ndarray, at: np.ndarray, rlen, left, llen, doc) -> np.ndarray:
    """For each suffix (place ``at`` in the merged order, whose shared prefixes are ``lcp`` and first equals ``new``) the
    windows a smaller document has.

    Suffixes with equal bytes on both sides stand for each other: only that of the smallest document is looked at.  A
    window starting o bytes before the anchor is the last o bytes before it and the first LENGTH - o from it.  Both
    have a number from the sorted order of their side, so windows are equal where both numbers are.
    """
    mask = np.zeros(len(at), np.int64)
    kin = np.cumsum(lcp < SEED)[at]  # suffixes that share their seed
    order = np.lexsort((doc, kin))
    first = np.concatenate([[True], kin[order][1:] != kin[order][:-1]])
    group = np.cumsum(first) - 1
    many = np.maximum.reduceat(doc[order], np.flatnonzero(first)) != doc[order][first]
    keep = order[many[group]]
    keep = keep[np.argsort(doc[keep], kind="stable")]  # by document, so the first of a group is its smallest
    if not len(keep):
        return mask
    x, n = left[keep], llen[keep]
    by = np.lexsort(_words(x)[::-1])
    differ = x[by][1:] != x[by][:-1]
    back = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), BACK)])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    whole = (np.cumsum(new)[at[keep]] * (len(by) + 1) + np.cumsum(back < BACK)[rank]) * (BACK + 1) + n
    order = np.argsort(whole, kind="stable")
    first = np.concatenate([[True], whole[order][1:] != whole[order][:-1]])
    head = np.empty(len(keep), np.int64)  # of each suffix, the one that stands for it
    head[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1]
    one = np.sort(order[first])  # still by document
    r, n, d, p, q = rlen[keep[one]], n[one], doc[keep[one]], at[keep[one]], rank[one]
    out = np.zeros(len(one), np.int64)
    for o in range(BACK + 1):
        ok = np.flatnonzero((r >= LENGTH - o) & (n >= o))
        if len(ok) < 2:
            continue
        key = np.cumsum(lcp < LENGTH - o)[p[ok]] * (len(by) + 1) + np.cumsum(back < o)[q[ok]]
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        smallest = d[ok][order][np.flatnonzero(first)][np.cumsum(first) - 1]
        out[ok[order[d[ok][order] > smallest]]] |= 1 << o
    place = np.zeros(len(keep), np.int64)
    place[one] = np.arange(len(one))
    lead = doc[keep[head]] < doc[keep]
    mask[keep] = np.where(lead, _reach(rlen[keep], llen[keep]), out[place[head]])
    return mask


def marks(docs: DataFrame, hot: int = 500_000) -> DataFrame:
    """(_id, _h, mark): anchors (place, then a bit a window) of documents (``_id`` bigint, ``_h`` text hash, ``_text`` bytes) with windows to remove.

    Suffixes go to the merge of their seed.  A seed that over ``hot`` documents have would be one large merge; its
    windows are sent one by one instead, each to the merge of its own bytes, and only where it is the same in each.
    """
    buckets = max(8, -(-(docs.agg(F.sum(F.length("_text"))).first()[0] or 0) // (13 * BUCKET)))
    bits, block, total, hots = repeated(docs, buckets, hot)
    spark, merges = docs.sparkSession, max(8, -(-total // MERGE))
    held = spark.sparkContext.broadcast((bits, hots.tobytes()))

    def send(it) -> Iterator[pa.RecordBatch]:
        table, hottest = np.frombuffer(held.value[0], np.uint8), np.frombuffer(held.value[1], np.uint64)

        def make(chunk: Chunk):
            import zstandard

            place, codes, owner = chunk.found()
            v = codes >> FINGERPRINT
            ok = _passes(v, table, buckets, block)
            place, v, owner = place[ok].astype(np.int64), v[ok], owner[ok].astype(np.int64)
            del codes, ok
            ids, hashes = np.array(chunk.ids, np.int64), np.array(chunk.hashes, np.int64)
            fire = np.isin(v, hottest)
            parts = [(place[~fire], owner[~fire], (v[~fire] % np.uint64(merges)).astype(np.int64), False)]
            if fire.any():
                # Windows of hot seeds as suffixes of their own: nothing before them, so only o = 0 can be settled.
                p, w = place[fire], owner[fire]
                o = np.arange(BACK + 1)
                start, who = (p[:, None] - o), np.repeat(w, BACK + 1)
                sizes = np.fromiter(map(len, chunk.texts), np.int64, len(chunk.texts))
                good = (start.ravel() >= 0) & (start.ravel() + LENGTH <= sizes[who])
                pairs = np.unique(who[good] * (1 << 40) + start.ravel()[good])
                parts.append((pairs & (1 << 40) - 1, pairs >> 40, None, True))
            packer = zstandard.ZstdCompressor(level=3)
            for place, owner, bucket, alone in parts:
                if not len(place):
                    continue
                right, rlen, left, llen = _context(chunk, place, owner)
                if alone:
                    left[:], llen = 0, np.zeros(len(llen), np.int64)
                    h = np.zeros(len(right), np.uint64)
                    for word in _words(right):
                        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(32)
                    bucket = merges + (h % np.uint64(merges)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1]]))
                for rows in np.split(by, cuts[1:]):
                    a = (right[rows], rlen[rows], left[rows], llen[rows], place[rows], owner[rows])
                    front, settled, rest = sorted_run(ids, *a)
                    who, number = np.unique(a[5], return_inverse=True)
                    entry = (a[2][rest].tobytes(), a[3][rest].astype(np.uint8), number[rest].astype(np.uint32), a[4][rest].astype(np.uint32))
                    done = (number[settled].astype(np.uint32), a[4][settled].astype(np.uint32), _reach(a[1][settled], a[3][settled]).astype(np.uint32))
                    blob = packer.compress(pickle.dumps((front, entry, done, ids[who], hashes[who]), 5))
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[rows[0]])], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "run"])

        yield from _chunks(it, make)

    def meet(bucket: int, runs: list[bytes]) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        loaded = [pickle.loads(unpack.decompress(r)) for r in runs]
        out = [(ids[who], hashes[who], at, mask) for _, _, (who, at, mask), ids, hashes in loaded]
        order, lcp = merge_runs([(_strings(*front[:3]), front[0].tolist()) for front, *_ in loaded])
        size = np.zeros(len(order), np.int64)
        for i, (front, *_) in enumerate(loaded):
            size[order == i] = front[1]
        new = (lcp < size) | (size != np.concatenate([[-1], size[:-1]]))
        where, rlens, lefts, llens, docs_, hashes_, ats = [], [], [], [], [], [], []
        for i, (front, (left, llen, who, at), _, ids, hashes) in enumerate(loaded):
            times = front[3].astype(np.int64)
            where.append(np.repeat(np.flatnonzero(order == i), times))
            rlens.append(np.repeat(front[1].astype(np.int64), times))
            lefts.append(np.frombuffer(left, np.uint8).reshape(-1, BACK))
            llens.append(llen.astype(np.int64))
            docs_.append(ids[who])
            hashes_.append(hashes[who])
            ats.append(at)
        where, rlen, left, llen, doc, h, at = map(np.concatenate, (where, rlens, lefts, llens, docs_, hashes_, ats))
        mask = settle(lcp, new, where, rlen, left, llen, doc) if len(where) else np.zeros(0, np.int64)
        hit = np.flatnonzero(mask)
        out.append((doc[hit], h[hit], at[hit], mask[hit]))
        ids, hashes, at, mask = (np.concatenate(x) for x in zip(*out))
        ok = mask != 0
        return pa.table({"_id": pa.array(ids[ok], pa.int64()), "_h": pa.array(hashes[ok], pa.int64()), "mark": pa.array(at[ok].astype(np.int64) << (BACK + 1) | mask[ok].astype(np.int64), pa.int64())})

    return _grouped(docs.mapInArrow(send, "bucket int, run binary"), "bucket", meet, "_id bigint, _h bigint, mark bigint")


def removed(mark: np.ndarray) -> list[tuple[int, int]]:
    """Maximal removed runs of a document from its marked anchors."""
    at, mask = mark >> (BACK + 1), mark & (1 << BACK + 1) - 1
    starts = np.concatenate([at[(mask >> o) & 1 == 1] - o for o in range(BACK + 1)])
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    lo, hi = starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + LENGTH
    return list(zip(lo.tolist(), hi.tolist()))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = 500_000) -> DataFrame:
    """key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if wanted, all columns with the text that is left.

    Every byte covered by a LENGTH-byte string that also starts in a document with a smaller key is removed; strings
    are judged on the input.  Texts that a smaller key has whole go whole by their digest.  Null or shorter texts lose
    nothing.  Keys are integers; a null key comes before all.  Rows with one key do not remove from each other, each
    row is judged by its own text.  What is left of a character cut in two is dropped from the text, not from the
    digest.  An empty table gives an empty result.
    """
    base = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NONE)).alias("_id"), F.xxhash64(text).alias("_h"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    digest = base.where(F.length("_text") >= LENGTH).select("_id", "_h", F.sha2("_text", 256).alias("_sha"))
    first = digest.groupBy("_sha").agg(F.min("_id").alias("_first"))
    copies = digest.join(first, "_sha").where(F.col("_id") > F.col("_first")).select("_id", "_h", F.lit(WHOLE).alias("mark"))
    found = marks(base, hot).unionByName(copies).groupBy("_id", "_h").agg(F.collect_list("mark").alias("_m"))
    rest = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)] if keep_text else [F.col(key).alias("_c0"), F.col(text).cast("string").alias("_c1")]
    names = docs.columns if keep_text else [key, text]
    t = names.index(text)
    rows = docs.select(*rest, F.coalesce(F.col(key).cast("bigint"), F.lit(NONE)).alias("_id"), F.xxhash64(text).alias("_h")).join(found, ["_id", "_h"], "left")
    fields = [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(names) if keep_text or c == key]
    more = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields if keep_text else fields + more)

    def cut(cols) -> Iterator[pa.RecordBatch]:
        size, gone, many, kept, left = [], [], [], [], []
        for x, m in zip(cols[f"_c{t}"], cols["_m"]):
            data = x.as_py().encode("utf-8", "surrogatepass") if x.is_valid else b""
            mark = m.values.to_numpy() if m.is_valid else np.zeros(0, np.int64)
            runs = [(0, len(data))] if (mark == WHOLE).any() else removed(mark)
            out, at = [], 0
            for lo, hi in runs:
                out.append(data[at:lo])
                at = hi
            out = b"".join([*out, data[at:]])
            size.append(len(data))
            gone.append(len(data) - len(out))
            many.append(len(runs))
            kept.append(hashlib.sha256(out).hexdigest())
            left.append(out.decode("utf-8", "ignore") if runs else x.as_py())
        mine = [pa.array(left, pa.string()) if i == t else cols[f"_c{i}"] for i, c in enumerate(names) if keep_text or c == key]
        told = [] if keep_text else [*[pa.array(v, pa.int64()) for v in (size, gone, many)], pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*mine, *told], schema.names)

    out = batches(rows, cut, schema)
    return out.select(*[F.col(f.name).alias(docs.columns[int(f.name[2:])] if keep_text else key) for f in fields], *[n.name for n in ([] if keep_text else more)])
