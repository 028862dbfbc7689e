"""Stages of the pipeline on a small table, each against what its operator's brute force says of its own input."""

import re

import corpus_pipeline as cp
from geofold.llm.common import stored

from .test_suffix_dedup import brute
from .test_text_operators import groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages(spark, docs, texts):
    held, rows = docs, texts
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5 and cp.ORACLE_SQL is None
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in held.select("doc_id", "text").collect()]
        held = stored(stage(spark, held, ""))
        if name != "pack":
            assert held.columns == docs.columns
            after = dict(tuple(r) for r in held.select("doc_id", "text").collect())
        if name == "language":
            letters = {i for i, t in before if re.search(r"[^\W\d_]", t or "")}
            assert set(after) <= letters and {r[0] for r in rows if r[0] < 10_000} <= set(after)
        elif name == "near copies":
            part = groups(before, 5, 80)
            assert set(after) == {i for i, (_, c) in part.items() if i == c}
        elif name == "repeated passages":
            want = {i: n - gone for i, n, gone, *_ in brute(before)}
            got = {i: len(t.encode()) for i, t in after.items()}
            assert set(got) == {i for i, n in want.items() if n} and all(0 <= want[i] - n <= 6 for i, n in got.items())
        elif name == "mix":
            assert set(after) <= {i for i, _ in before}
    ends = held.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 4096 for r in ends)


def test_edges(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "one two three four five six", None, None, None), (2, "one two three four five six", None, None, None), (3, "other words in here", "en", "a", 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", _id string")
    for empty in (False, True):
        held = df.where("false") if empty else df
        for name, stage in cp.STAGES:
            cut = stored(stage(spark, held, ""))
            if name == "near copies" and not empty:
                assert sorted(r["doc_id"] for r in cut.collect()) == [2, 3]
            held = cut
        assert empty == (held.count() == 0)
