import re
from collections import defaultdict

import pytest

from geofold.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    """Reshare the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        out = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def test_mix(spark, docs, texts):
    size, source = {}, defaultdict(int)
    for i, t, _, s, _ in texts:
        size[i] = len(WORD.findall(t or ""))
        source[s] += size[i]
    of = {r[0]: r[3] for r in texts}
    want = expected_targets(source)
    rows = mixing.mix(docs, shard_words=20_000).collect()
    assert rows and {r["doc_id"]: r["size"] for r in rows} == size
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == source[of[r["doc_id"]]] and r["target"] == pytest.approx(want[of[r["doc_id"]]])
        assert r["taken"] == r["rounds"] * r["size"] + sum(x["hi"] - x["lo"] for x in r["ranges"]) <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3), shard_words=20_000).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixed_texts_have_the_words_taken(spark, docs):
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    for r in mixing.apply_mix(docs).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert all(got[i] == n for i, n in plan.items())


def test_edges(spark):
    schema = "doc_id bigint, text string, source string, size int, _src string, taken int"
    rows = [(1, None, None, 1, "a", 1), (1, None, None, 1, "a", 1), (None, "a b c", "x", 1, "a", 1), (2, " ", "x", 1, "b", 1), (3, "w " * 5000, "y", 1, "", 0), (3, "w " * 5000, "y", 1, "", 0)]
    df = spark.createDataFrame(rows, schema)
    assert mixing.mix(df).count() == 6
    assert mixing.apply_mix(df).columns == df.columns
    assert mixing.mix(df.where("false")).collect() == []
    assert sum(r["taken"] for r in mixing.mix(df.where("doc_id = 1")).collect()) == 0


def test_sainte_lague(spark):
    votes = [5300, 2400, 1200, 900, 200, 0, 1]
    for seats in (0, 1, 7, 30, 101):
        df = spark.createDataFrame([("g", i, v, seats) for i, v in enumerate(votes)], "g string, i int, v bigint, q bigint")
        got = {r["i"]: r["s"] for r in mixing.sainte_lague(df, ["g"], "v", "q", ["i"], "s").collect()}
        best = sorted(((-v / (2 * j + 1), i) for i, v in enumerate(votes) for j in range(seats)))[:seats]
        want = {i: sum(1 for _, k in best if k == i) for i in range(len(votes))}
        assert got == want


def test_small_sources_get_their_share(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 5000), ("b", 4), ("c", 2), ("d", 1), ("e", 100), (None, 37), ("f", 64), ("g", 7)])]
    for part in (rows, rows[1:4], rows[1:3], rows[3:4], [(0, "w " * 6, "a"), (1, "w " * 4, "b")]):
        want = expected_targets({s: len(t) // 2 for _, t, s in part})
        got = {part[r["doc_id"] - part[0][0]][2]: r for r in mixing.mix(spark.createDataFrame(part, "doc_id int, text string, source string")).collect()}
        assert all(abs(got[s]["taken"] - t) <= 1 and got[s]["taken"] <= 3 * got[s]["size"] for s, t in want.items())
        assert abs(sum(r["taken"] for r in got.values()) - sum(want.values())) <= 1
