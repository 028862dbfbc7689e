import hashlib
import random

import numpy as np
import pytest

from geofold.llm import byte_bpe


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), "<i4").tolist()


def test_ids_are_those_of_the_library(whole):
    coder, back, rnd = byte_bpe.Encoder(None), byte_bpe.Decoder(None), random.Random(3)
    for letters in ("abcdefgh étßñ 日本語 \n\t.,!'s 0123 АБВ ا🎉", "aeinrst", "ab ", "  \n=-"):
        for _ in range(300):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120)))
            ids = ids_of(coder, t)
            assert ids == whole.encode_ordinary(t) and back.decode(ids) == t
    for t in ("a" * 20_000, "ab" * 9_000, "=" * 5_000, "".join(rnd.choice("aeinrst") for _ in range(12_000))):
        assert ids_of(coder, t) == whole.encode_ordinary(t)


def test_bounded_tables_and_early_writing(whole, monkeypatch):
    for name, value in (("STATES", 50), ("MOVES", 60), ("PAIRS", 40), ("PIECES", 5), ("STRIDE", 40)):
        monkeypatch.setattr(byte_bpe, name, value)
    coder, back, rnd = byte_bpe.Encoder(None), byte_bpe.Decoder(None), random.Random(5)
    for _ in range(60):
        t = "".join(rnd.choice("aeinrst é") for _ in range(rnd.randint(0, 700)))
        ids = ids_of(coder, t)
        assert ids == whole.encode_ordinary(t) and back.decode(ids) == t
    assert len(coder) <= 5 and len(coder.transducer.moves) <= 60


def test_pieces_that_merges_do_not_reach():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 301, b"xy": 302}
    t = byte_bpe.Transducer(ranks)
    assert t.encode(b"abc") == [301]  # a + bc is a merge here, too
    t = byte_bpe.Transducer({bytes([b]): b for b in range(256)} | {b"abcd": 300})
    assert t.encode(b"abcd") == [300] and t.encode(b"abcde") == [97, 98, 99, 100, 101]


def test_utf8_machine():
    rnd = random.Random(1)
    for _ in range(3_000):
        data = bytes(rnd.choice([rnd.randrange(256), 0xE0, 0xED, 0xF0, 0xF4, 0x80, 0xA0]) for _ in range(rnd.randint(0, 10)))
        cut = rnd.randint(0, len(data))
        first, held = byte_bpe.advance(b"", data[:cut])
        rest, held = byte_bpe.advance(held, data[cut:])
        assert first + rest + ("�" if held else "") == data.decode(errors="replace")
    coder = byte_bpe.Decoder(None)
    of = {v: k for k, v in coder.bytes_of.items()}
    parts = list(coder.feed([i for b in "é🎉".encode() for i, token in [(k, v) for k, v in coder.bytes_of.items()] if token == bytes([b])]))
    assert "".join(t for t, _ in parts) == "é🎉" and of and any(held for _, held in parts) and parts[-1][1] == b""


def test_query(spark, docs, texts, whole):
    rows = {r["doc_id"]: r for r in byte_bpe.digests(docs).collect()}
    assert len(rows) == len(texts)
    for i, t, *_ in texts:
        ids = whole.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == want


def test_edges(spark):
    df = spark.createDataFrame([(None, None, "a", 1), (None, None, "a", 1), (1, "", "b", 2), (2, "one", None, 3)], "doc_id bigint, text string, ids string, decoded int")
    out = byte_bpe.encode(df)
    assert out.columns == [*df.columns, "ids_"]
    got = byte_bpe.decode(out, "ids_").collect()
    assert sorted(r["decoded_"] for r in got) == ["", "", "", "one"] and len(got) == 4
    assert byte_bpe.digests(df).count() == 4 and byte_bpe.digests(df.where("false")).collect() == []
    lone = spark.createDataFrame([(byte_bpe.load_ranks()[b"\xe9"],), (None,)], "i int").selectExpr("case when i is not null then array(i) end as ids")
    assert sorted(r["decoded"] for r in byte_bpe.decode(lone).collect()) == ["", "�"]
