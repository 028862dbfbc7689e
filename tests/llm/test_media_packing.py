import hashlib
import random
import struct
import zlib

import numpy as np

from geofold.llm import media, packing


def test_container_round_trip():
    for n in (0, 1, 575, 576, 577, 576 * 40, 576 * 41 + 3):
        data = bytes(random.Random(n).randbytes(n))
        payload = media.pad(data)
        stored = media.write_container(payload)
        (t,) = media.probe_container(stored)
        assert b"".join(stored[r["start"]:r["start"] + r["length"]] for r in t["runs"]) == payload
        assert t["codec"] == "raw " and t["samples"] == len(payload) // 576 and t["duration"] == len(payload)
        keys = [payload[i * 576:(i + 1) * 576] for i in range(0, t["samples"], media.SYNC)]
        assert [stored[k["start"]:k["start"] + k["length"]] for k in t["keyframes"]] == keys


def test_prober_takes_other_layouts():
    payload = b"abcdefghij"
    entry = media.box(b"avc1", bytes(78))
    ftyp = media.box(b"ftyp", b"isom", bytes(4))
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload  # a 64-bit size, before the movie box
    first = len(ftyp) + 16
    stbl = media.box(
        b"stbl", media.full(b"stsd", struct.pack(">I", 1), entry), media.full(b"stts", struct.pack(">IIIII", 2, 2, 5, 1, 7)),
        media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 2, 1)), media.full(b"stsz", struct.pack(">IIIII", 0, 3, 2, 3, 5)), media.full(b"co64", struct.pack(">IQQ", 2, first, first + 2)),
    )
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">QQIQ", 0, 0, 10, 0), bytes(4), version=1), media.box(b"minf", stbl))
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 9, 0, 0), bytes(60)), mdia)
    body = media.box(b"moov", trak)
    moov = struct.pack(">I", 0) + body[4:]  # size 0: to the end
    (t,) = media.probe_container(ftyp + mdat + moov)
    assert (t["track_id"], t["codec"], t["duration"], t["duration_s"], t["bytes"]) == (9, "avc1", 17, 1.7, 10)
    assert [(k["start"] - first, k["length"]) for k in t["keyframes"]] == [(0, 2), (2, 3), (5, 5)]
    assert media.probe_container(b"") == [] and media.probe_container(b"\0\0\0\1moov") == [] and media.probe_container((ftyp + mdat + moov)[:-40]) == []


def test_media_query(spark, docs, texts):
    rows = {r["doc_id"]: r for r in media.digests(media.probe(media.encode(docs))).collect()}
    for i, t, *_ in texts:
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = spark.createDataFrame([(None, "a", b"x", 1), (None, "a", b"x", 1)], "doc_id bigint, text string, media binary, tracks int")
    a, b = media.digests(media.probe(media.encode(same))).collect()
    assert a == b and media.digests(media.probe(media.encode(same.where("false")))).collect() == []


def test_nnls_and_plan():
    rng = np.random.default_rng(0)
    a, x = rng.random((20, 8)), np.array([0, 3, 0, 1.5, 0, 0, 2, 4])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    b = rng.normal(size=20)
    y = packing.nnls(a, b)
    slope = a.T @ (b - a @ y)
    assert (y >= 0).all() and (slope <= 1e-6).all() and np.allclose(slope[y > 0], 0, atol=1e-6)
    for h in (np.zeros(32, int), np.eye(32, dtype=int)[31] * 5, rng.integers(0, 60, 32), rng.poisson(0.5, 32)):
        plan = packing.solve(h)
        used = np.zeros(32, int)
        for way, times in plan:
            assert times > 0 and sum(way) <= 32
            for x in way:
                used[x - 1] += times
        assert (used == h).all()


def test_pack(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack_documents(docs, keep_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        got = sorted(by[i], key=lambda r: r["start"])
        assert [x for r in got for x in r["ids"]] == ids and {r["doc_tokens"] for r in got} == {len(ids)}
        at = 0
        for r in got:
            assert r["start"] == at and r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sum(r["length"] for r in rows) / (4096 * len(sequences)) > 0.93


def test_odd_tokens():
    e = packing.Encoder(packing.tokenizer_path())
    for s in ("It's 'S can't, don't.. x,y. A,b", "ÉTÉ é ΣΑΣ Σ. ﬁ ²3 a_b __ 12.5,", "tab\tnew\nline\x0bx\x1cy\x85z w　v", "!!", "a" * 200, "İI"):
        assert np.frombuffer(e.encode(s), "<u4").tolist() == e.whole.encode(s, add_special_tokens=False).ids


def test_pack_edges(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b c", 3), (None, "a b c", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    assert packing.pack_documents(df).count() == 5
    assert packing.pack_documents(df.where("false")).collect() == []
