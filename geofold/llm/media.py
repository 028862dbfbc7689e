"""ISO media containers: a writer for 8-bit sample tracks, and a prober that walks boxes and decodes sample tables."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

UNIT = 576
#: Every so many samples one is a sync sample (key frame).
SYNC = 8
#: Samples of a chunk.
CHUNK = 4
SCALE = 8000
#: Bytes of text after which a batch of containers is handed on.
HELD = 8 << 20
#: Boxes that hold other boxes.
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex"}

TRACK = "track_id:int,codec:string,timescale:bigint,duration:bigint,duration_s:double,samples:bigint,bytes:bigint,keyframes:array<struct<start:bigint,length:bigint>>,runs:array<struct<start:bigint,length:bigint>>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of the unit."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def write_container(payload: bytes) -> bytes:
    """One track of unsigned 8-bit samples (``raw ``), a sample per unit; the payload follows the header unchanged."""
    n = len(payload) // UNIT
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = n * UNIT
    wide = duration >= 1 << 32
    times = struct.pack(">QQIQ", 0, 0, SCALE, duration) if wide else struct.pack(">IIII", 0, 0, SCALE, duration)
    span = struct.pack(">QQIIQ", 0, 0, 1, 0, duration) if wide else struct.pack(">IIIII", 0, 0, 1, 0, duration)
    version = int(wide)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, SCALE << 16))
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else ([(1, CHUNK, 1)] if chunks > 1 else []) + [(chunks, n % CHUNK, 1)]
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    sync = range(1, n + 1, SYNC)

    def moov(first: int) -> bytes:
        offsets = [first + i * CHUNK * UNIT for i in range(chunks)]
        far = offsets[-1] >= 1 << 32
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if far else b"stco", struct.pack(f">I{chunks}{'Q' if far else 'I'}", chunks, *offsets)),
        )
        dref = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        media = box(
            b"mdia", full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=version),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"), box(b"minf", full(b"smhd", bytes(4)), dref, table),
        )
        head = full(b"tkhd", span, bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=version, flags=7)
        movie = full(b"mvhd", times, struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2), version=version)
        return box(b"moov", movie, box(b"trak", head, media))

    start = len(ftyp) + len(moov(0)) + 8
    if len(payload) + 8 >= 1 << 32:
        start += 8
    if start + len(payload) >= 1 << 32:  # the wider offsets make the header longer
        start += len(moov(1 << 32)) - len(moov(0))
    return ftyp + moov(start) + box(b"mdat", payload)


def walk(data, lo: int, hi: int):
    """Boxes in ``data[lo:hi]`` as (kind, body start, body end); 64-bit sizes, size 0 to the end; a torn box ends the walk."""
    while lo + 8 <= hi:
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if lo + 16 > hi:
                return
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            return
        yield kind, lo + head, lo + size
        lo += size


def tree(data, lo: int, hi: int):
    for kind, a, b in walk(data, lo, hi):
        yield kind, a, b
        if kind in PARENTS:
            yield from tree(data, a, b)


def probe_container(data: bytes) -> list[dict]:
    """Tracks of a container, from its boxes alone: codec, duration, byte ranges of key frames and of all samples.

    Torn or foreign bytes give the tracks whose tables are whole, or none.
    """
    tracks = []
    for kind, lo, hi in walk(data, 0, len(data)):
        if kind == b"moov":
            for k, a, b in walk(data, lo, hi):
                if k == b"trak":
                    try:
                        tracks.append(_track(data, a, b))
                    except (struct.error, KeyError, IndexError, ValueError):
                        continue
    return tracks


def _ints(data, at: int, n: int, end: int, form: str = "I") -> tuple:
    width = struct.calcsize(form)
    if at + n * width > end:
        raise ValueError("torn table")
    return struct.unpack_from(f">{n}{form}", data, at)


def _track(data, lo: int, hi: int) -> dict:
    at = {kind: (a, b) for kind, a, b in tree(data, lo, hi)}
    a, b = at[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
    head = at[b"tkhd"][0]
    track_id = struct.unpack_from(">I", data, head + (20 if data[head] else 12))[0]
    codec = bytes(data[at[b"stsd"][0] + 12:at[b"stsd"][0] + 16]).decode("latin-1")
    a, b = at[b"stsz"]
    same, n = struct.unpack_from(">II", data, a + 4)
    sizes = (same,) * n if same else _ints(data, a + 12, n, b)
    a, b = at.get(b"co64") or at[b"stco"]
    offsets = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], b, "Q" if b"co64" in at else "I")
    a, b = at[b"stsc"]
    flat = _ints(data, a + 8, 3 * struct.unpack_from(">I", data, a + 4)[0], b)
    runs = list(zip(flat[::3], flat[1::3]))
    a, b = at[b"stts"]
    flat = _ints(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0], b)
    ticks = sum(c * d for c, d in zip(flat[::2], flat[1::2]))
    starts, sample, ranges = [], 0, []
    for i, (first, per) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        for chunk in range(first - 1, last - 1):
            place = offsets[chunk]
            ranges.append((place, sum(sizes[sample:sample + per])))
            for s in sizes[sample:sample + per]:
                starts.append(place)
                place += s
            sample += per
    if len(starts) != n:
        raise ValueError("sample tables disagree")
    if b"stss" in at:
        a, b = at[b"stss"]
        sync = [s - 1 for s in _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], b)]
    else:  # without the table every sample is one
        sync = range(n)
    merged: list[list[int]] = []
    for start, length in ranges:
        if merged and merged[-1][0] + merged[-1][1] == start:
            merged[-1][1] += length
        else:
            merged.append([start, length])
    return {
        "track_id": track_id, "codec": codec, "timescale": scale, "duration": duration or ticks, "duration_s": (duration or ticks) / scale if scale else None,
        "samples": n, "bytes": sum(sizes), "keyframes": [{"start": starts[s], "length": sizes[s]} for s in sync],
        "runs": [{"start": s, "length": x} for s, x in merged],
    }


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``n_bytes`` and ``media``: each whole text as an ISO container of 8-bit samples.

    Null texts count as empty; an empty text is one unit of padding.  Equal texts give equal bytes.  Rows stay rows,
    whatever their key (null and repeated ones too); an empty table gives none; other columns are not read.
    """
    df = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))
    kind = docs.schema[key].dataType.simpleString()

    def make(cols):
        ids, raw = cols["_id"], cols["_bytes"]
        sizes = pa.compute.binary_length(raw).to_pylist()
        lo, held = 0, 0
        for i, n in enumerate(sizes):  # a batch of long texts is never held twice
            held += n
            if held >= HELD or i + 1 == len(sizes):
                part = raw.slice(lo, i + 1 - lo)
                stored = pa.array([write_container(pad(x.as_py())) for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(part)), pa.array(sizes[lo:i + 1], pa.int64()), stored], ["_id", "n_bytes", "media"])
                lo, held = i + 1, 0

    return batches(df, make, f"_id {kind}, n_bytes bigint, media binary").withColumnRenamed("_id", key)


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """Add ``tracks`` (array of structs: codec, duration, key-frame byte ranges, sample runs); payloads are not decoded."""
    names = media.columns
    tracks = pa.list_(pa.struct([
        ("track_id", pa.int32()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("bytes", pa.int64()),
        *[(n, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))) for n in ("keyframes", "runs")],
    ]))

    def look(cols):
        found = [probe_container(x.as_py()) if x.is_valid else [] for x in cols[column]]
        yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(found, tracks)], [*names, "tracks"])

    return batches(media, look, T.StructType([*media.schema.fields, T.StructField("tracks", T.ArrayType(T._parse_datatype_string(f"struct<{TRACK}>")))]))


def digests(probed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read the payload back through the sample runs of the first track, and digest it and the stored form."""
    df = probed.select(F.col(key).alias("_id"), "n_bytes", "media", "tracks")
    kind = probed.schema[key].dataType.simpleString()

    def read(cols):
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media, tracks in zip(cols["media"], cols["tracks"]):
            data, t = media.as_py(), tracks.as_py()[0]
            payload = b"".join(data[r["start"]:r["start"] + r["length"]] for r in t["runs"])
            keys = hashlib.sha256(struct.pack(f">{2 * len(t['keyframes'])}Q", *[x for r in t["keyframes"] for x in (r["start"], r["length"])])).hexdigest()[:16]
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(f"codec={t['codec']!r} duration={t['duration']}/{t['timescale']} samples={t['samples']} keyframes={len(t['keyframes'])} ranges={keys}")
        arrays = [pa.array(v, pa.int64() if k[-5:] in ("bytes", "crc32") else pa.string()) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([cols["_id"], cols["n_bytes"], *arrays], ["_id", "n_bytes", *out])

    return batches(df, read, f"_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("_id", key)
