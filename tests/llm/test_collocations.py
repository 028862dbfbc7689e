import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from geofold.llm import collocations
from tests.oracle import connect, rows_of

from .conftest import SF


def brute(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = set()
    for lang, c in f.items():
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in many.items():
            if any(b >= a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in many.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


SCHEMA = "doc_id bigint, text string, lang string"


@pytest.mark.parametrize("shards", [1, 2, 4])
def test_against_brute_force(spark, texts, shards):
    rows = [(i, t, lang) for i, t, lang, *_ in texts if i < 60] + [(1000 + i, "A b C d E f; b c d\tE f\vg b c d e f " * (i % 4), "xx") for i in range(40)]
    rows += [(2000 + i, " ".join("abcde"[(i * j) % 5] for j in range(60)) + ",", None) for i in range(30)] + [(None, None, "xx"), (None, "", None), (3, "und", "und"), (3, "und", "und")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, 20)
    got = collocations.mine(df, least=20, shards=shards).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30


def test_few_marks_count_right(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MARK_BITS", 1 << 7)  # everything is marked: more is counted, nothing else changes
    rows = [(i, "one two three four five six seven " * 3 + f"x{i % 7} y{i % 5} ", "a") for i in range(50)]
    got = {tuple(r) for r in collocations.mine(spark.createDataFrame(rows, SCHEMA), least=10, top=9).collect()}
    assert got == brute(rows, 10, top=9)


def test_parts_of_a_language_and_top(spark):
    rows = [(i, " . ".join(f"w{(i * j) % 40} v{(i * j) % 40}" for j in range(40)), None) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in collocations.mine(df, least=3, top=7, part_rows=4).collect()}
    assert got == brute(rows, 3, top=7) and len(got) == 7


def test_wide_numbers(spark):
    big = spark.createDataFrame([(3 * 10**9, 4 * 10**9, 3 * 10**9, 10**13)], "a bigint, l bigint, r bigint, n bigint")
    assert big.selectExpr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s").first()[0] == 1000 * 3 * 10**9 * 10**13 // (4 * 10**9 * 3 * 10**9)


def test_marks():
    bits = np.zeros(16, np.uint64)
    code = np.array([5, 1 << 40 | 77], np.uint64)
    for c in code.tolist():
        for p in (c & 1023, (c >> 32) & 1023):
            bits[p >> 6] |= np.uint64(1 << (p & 63))
    assert collocations._marked(code, bits).all() and not collocations._marked(np.array([9], np.uint64), bits).any()


def test_words_of_any_bytes():
    texts = ["a\x00b \t c\u2003d.E,,e\x1f f\x85 ", "", " ", "\x0b\x0cZ\u00e9 \u0130x:", "a\x00b"]
    at, names = collocations.numbered([t.encode() for t in texts])
    data = collocations.MARK.join(t.encode() for t in texts).translate(collocations.PREPARE)
    assert [names[i] for i in at] == [b"\xff", *data.replace(b"\xff", b" \xff ").split()]


@pytest.mark.parametrize("least", [3, 300])
@pytest.mark.parametrize("held", [1, 1 << 22])
def test_buckets_of_pairs(spark, monkeypatch, least, held):
    monkeypatch.setattr(collocations, "HELD_PAIRS", held)
    monkeypatch.setattr(collocations, "BLOCK", 64)
    monkeypatch.setattr(collocations, "STEP_BYTES", 200)
    rows = [(lang, " ".join(f"w{(i * j) % 50}" for j in range(30)) + ". x y") for i in range(400) for lang in ("a", "b")]
    want = {}
    for lang, text in rows:
        at, names = collocations.numbered([text.encode()])
        places = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
        for b in collocations._pair_buckets(*collocations.word_codes(lang, names), at, places, 1024).tolist():
            want[b] = want.get(b, 0) + 1
    bits = collocations.heavy_buckets(spark.createDataFrame(rows, "lang string, text string").repartition(7), 1024, least)
    every = np.arange(1024, dtype=np.uint64)
    assert every[collocations._has(every, bits)].tolist() == sorted(b for b, n in want.items() if n >= least) != []


def test_query_equals_sql(spark):
    df = collocations.mine(spark.read.parquet(f"{SF}/documents.parquet"))
    found = connect(SF).execute(collocations.mine_sql())
    columns = [d[0] for d in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall()) != []


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, 1)], SCHEMA + ", phrase int")
    assert collocations.mine(df).collect() == [] and collocations.mine(df.where("false")).collect() == []


def test_frequent_phrases_are_named_by_few_tasks(spark, monkeypatch):
    """Rows of the naming scans follow the phrases, not phrases times tasks; what no early text has is named all the same."""
    rows = [(i, " ".join(f"w{(i * j) % 7} v{j % 5}" for j in range(20)) + ".", "a") for i in range(960)]
    rows += [(2000 + i, f"only{i} here{i} " * 12, f"l{i}") for i in range(12)]
    told, scan = [], collocations._scan

    def counted(texts, bits, heavy, longest, schema, tell):
        out = scan(texts, bits, heavy, longest, schema, tell)
        if schema == collocations.NAMES:
            told.append(out.count())
        return out

    monkeypatch.setattr(collocations, "_scan", counted)
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # a task a file
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(16)
        got = {(r["lang"], r["phrase"]): r["count"] for r in collocations.frequent_phrases(df, least=10, longest=2, shards=1).where("length > 0").collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = Counter()
    for _, text, lang in rows:
        for piece in text.split("."):
            w = piece.split()
            want.update((lang, " ".join(w[i:i + k])) for k in (1, 2) for i in range(len(w) - k + 1))
    assert got == {p: c for p, c in want.items() if c >= 10}
    assert sum(told) < 8 * len(got)
