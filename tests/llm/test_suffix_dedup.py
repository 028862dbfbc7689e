import hashlib
import random

import numpy as np
import pytest

from geofold.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    data = sorted(((-1 << 63 if i is None else i), (t or "").encode()) for i, t in rows)
    for i, b in data:
        for p in range(len(b) - 49):
            first.setdefault(b[p:p + 50], i)
    out = []
    for i, b in data:
        runs = []
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < i:
                if runs and runs[-1][1] >= p:
                    runs[-1][1] = p + 50
                else:
                    runs.append([p, p + 50])
        kept, at = b"", 0
        for lo, hi in runs:
            kept, at = kept + b[at:lo], hi
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(((-1 << 63 if r[0] is None else r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize("hot", [500_000, 3])
def test_against_brute_force(spark, docs, texts, hot):
    assert rows_of(sd.spans(docs, hot=hot)) == brute([(r[0], r[1]) for r in texts])


def test_edges(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    shared = word(90)
    rows = [(None, shared + word(20)), (3, word(30) + shared), (3, shared), (5, word(40) + shared[:50] + word(20) + shared[40:]), (6, shared[:49]), (7, None), (8, ""), (9, "a" * 400), (10, "b" + "a" * 120), (11, "a" * 400)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, _m int, _id string").repartition(5)
    assert rows_of(sd.spans(df)) == brute(rows)
    assert sd.spans(df.where("false")).collect() == []
    left = sd.spans(df, keep_text=True)
    assert left.columns == df.columns and left.count() == len(rows)


def test_loser_tree_orders_and_counts_prefixes():
    rnd = random.Random(1)
    runs = []
    for _ in range(7):
        s = sorted("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))).encode() for _ in range(rnd.randint(0, 40)))
        known = [0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(s, s[1:])]
        runs.append((s, known[:len(s)]))
    order, lcp = sd.merge_runs(runs)
    at, out = [0] * len(runs), []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(x for s, _ in runs for x in s)
    for a, b, k in zip(out, out[1:], lcp[1:]):
        assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


def test_buckets_of_the_filter_are_the_senders():
    """With very many buckets a fingerprint at a border is looked for where it was sent."""
    buckets = 1_200_000
    border = (np.arange(buckets + 1, dtype=np.float64) * (float(1 << 40) / buckets)).astype(np.uint64)
    v = border[:-1][::40]
    sent = np.searchsorted(border, v, side="right") - 1
    bits = np.zeros(buckets * 8, np.uint8)
    for p in sd._probes(v, 64):
        np.bitwise_or.at(bits, sent * 8 + (p >> 3), (1 << (p & 7)).astype(np.uint8))
    assert sd._passes(v, bits, buckets, 64).all()
