import re
import textwrap
from collections import Counter
from math import comb

import duckdb
import numpy as np
import pytest

from geofold.llm import html_text, language, licenses, ngram_join, queries, quality_nbsvm, quality_rules

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(rows, width, percent):
    """(set sizes, component of each row) by comparing all pairs of sets that share an n-gram."""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set())
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    seen = {}
    for i, s in enumerate(sets):
        for j in {j for x in s for j in seen.get(x, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                part[root(i)] = root(j)
        for x in s:
            seen.setdefault(x, []).append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return {k: (len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_join_against_all_pairs(spark, docs, texts, width, percent):
    rng = np.random.default_rng(width)
    rows = [(r[0], r[1]) for r in texts]
    words = [f"v{i}" for i in rng.integers(0, 400, 150)]
    for i in range(60):  # near copies at about the border
        w = list(words)
        for p in rng.integers(0, 150, rng.integers(0, 9)):
            w[p] = f"u{rng.integers(0, 5)}"
        rows.append((20_000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, width=width, percent=percent).collect()}
    assert got == groups(rows, width, percent)


def test_join_links_components_whose_lead_changes(spark):
    """x and y share two prefix tokens, one led by x's side and one by y's; only both together are what they ask for."""
    rows = []
    for f in range(12):  # each family's leaders are other documents; a leader x or y would find the link at once
        core, t1, t2, own = [f"c{f}_{i}" for i in range(18)], f"s{f}", f"t{f}", [f"o{f}", f"p{f}"]
        texts = [[*core, t1, t2, *own], [*core, t1, t2]]
        texts += [[c for c in core if c != core[i]] + [t1, *own] for i in range(18)] + [[c for c in core if c != core[i]] + [t2] for i in range(18)]
        rows += [(100 * f + i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, width=1, percent=90).collect()}
    assert got == groups(rows, 1, 90) and {c for _, c in got.values()} == {100 * f for f in range(12)}


def test_join_null_and_repeated_keys(spark):
    """A null key links two texts that are not similar to each other; texts under one key link by themselves."""
    words = [f"w{i}" for i in range(100)]
    edit = lambda k: [f"x{i}" if i < k else w for i, w in enumerate(words)]
    a, between, b = words, edit(4), edit(4)[:-4] + [f"y{i}" for i in range(4)]
    rows = [(5001, " ".join(a)), (None, " ".join(between)), (5002, " ".join(b)), (None, "quite another text of its own"), (None, None)]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [("5001", "5001"), ("5002", "5001"), ("None", "5001"), ("None", "None"), ("None", "None")]
    rng, rows = np.random.default_rng(9), []
    for f in range(12):
        base = [f"f{f}_{i}" for i in range(60)]
        for k in range(3):
            w = list(base)
            w[rng.integers(0, 60)] = f"z{f}_{k}"
            rows.append((7 if k < 2 else 100 + f, " ".join(w)))  # two texts of each family under one key of all
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string"), width=1, percent=80).collect()
    assert len(found) == 36 and {r["component_id"] for r in found} == {7}


def test_join_edges(spark):
    rows = [(None, "a b c d", 1), (5, "A B C D", 1), (7, "", 1), (8, None, 1), (9, "é", 1), (9, "é", 1), (11, "x y", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect())
    assert got == sorted([("None", 2, 5), ("5", 2, 5), ("7", 0, 7), ("8", 0, 8), ("9", 1, 9), ("9", 1, 9), ("11", 1, 11)])
    assert ngram_join.join(df.where("false")).collect() == []


def test_language_scores_sum_all_segmentations():
    v = language.vocabulary(None)
    rng = np.random.default_rng(2)
    probs = np.vstack([rng.random((len(v.codes), 2)) / len(v.codes), np.zeros((1, 2))])
    at = {int(c): i for i, c in enumerate(v.codes)}

    def brute(s):
        if not s:
            return np.ones(2)
        total = np.zeros(2)
        for n in range(1, len(s) + 1):
            i = at.get(v.code(s[:n]))
            p = probs[i] if i is not None and s[:n] != "▁" else np.zeros(2)
            total += (np.maximum(p, language.UNKNOWN) if n == 1 else p) * brute(s[n:])
        return total

    words = ["the", "maison", "straße", "x", "ooo"]
    assert np.allclose(language.forward(words, v, probs), [np.log(brute("▁" + w)) for w in words])
    use = language.expected(words, np.ones((5, 2)), v, probs)
    assert use.sum() > 0
    for w in words:  # a long word's way gives the same
        assert np.allclose(language.long_word(w, v, probs), language.forward([w], v, probs)[0])
        _, ids, many = language.long_word(w, v, probs, True)
        assert np.allclose(np.stack([np.bincount(ids, many[:, k], len(probs)) for k in range(2)], 1), language.expected([w], np.ones((1, 2)), v, probs))


def test_language_long_runs():
    """Runs of hundreds of letters against sums of logarithms over all segmentations."""
    v = language.vocabulary(None)
    rng = np.random.default_rng(3)
    probs = np.vstack([rng.random((len(v.codes), 2)) / len(v.codes), np.zeros((1, 2))])
    at = {int(c): i for i, c in enumerate(v.codes)}

    def brute(s):
        logs = [np.zeros(2)]
        for end in range(1, len(s) + 1):
            parts = []
            for n in range(1, min(end, v.length) + 1):
                i = at.get(v.code(s[end - n:end]))
                p = probs[i] if i is not None and s[end - n:end] != "▁" else np.zeros(2)
                p = np.maximum(p, language.UNKNOWN) if n == 1 else p
                if p.any():
                    parts.append(logs[end - n] + np.log(p))
            logs.append(np.logaddexp.reduce(parts))
        return logs[-1]

    long = ["".join(rng.choice(list("aeinrstlodu"), 200)), "x" * 33, "的" * 500, "straße" * 700]
    assert language.runs(" ".join(long)) == long
    assert np.allclose(language.forward(long + ["the"], v, probs), [brute("▁" + w) for w in long + ["the"]])


def test_language(spark, docs, texts):
    rows = {r["doc_id"]: r for r in language.identify(docs, sample=60).collect()}
    truth = {r[0]: r[2] for r in texts if r[0] < 10_000}
    out = [i for i in truth if rows[i]["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in out]) > 0.95
    assert all(rows[r[0]]["lang_pred"] == "und" and rows[r[0]]["score"] == 0 for r in texts if not re.search(r"[^\W\d_]", r[1] or ""))
    odd = spark.createDataFrame([(None, "Hello there", None), (1, None, "en"), (1, "12 ²", "en")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language.identify(odd).count() == 3 and language.identify(odd.where("false")).collect() == []


def test_licenses(spark):
    mit, isc = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"]
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace(" ", "  ")), (3, mit + " more"), (4, isc.replace('"', "'")),
        (5, None), (6, ""), (6, ""), (None, "released under the  MIT licence"), (7, "Licensed under the Apache License, v2.0"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, license string")
    got = [(r["doc_id"], r["license"]) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, "ISC"), (5, None), (6, None), (6, None), (None, "MIT (notice)"), (7, "Apache-2.0 (notice)")], key=str)
    assert licenses.scan(df.where("false")).collect() == []


def test_licenses_as_distributed(spark):
    """Files with heading and copyright line, wrapped so that lines begin with 'copyright', give their licence."""
    mit, isc = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"]
    whole = {f.stem: f.read_text("utf-8") for f in licenses.FOLDER.glob("*.txt")}
    wrapped = isc.replace("above copyright", "above\ncopyright")
    assert "\ncopyright notice and" in wrapped
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit), ("ISC", "ISC License\n\nCopyright 2020, A. Person\n\n" + wrapped), ("ISC", "Copyright Some Company, Inc.\n" + wrapped), ("Unlicense", whole["Unlicense"])]
    rows += [(n, "\n\n".join(textwrap.fill(p, w) for p in t.split("\n\n"))) for n, t in whole.items() if n.startswith(("BSD", "Unl")) for w in range(30, 90, 7)]
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, B\nAll rights reserved.\n\n" + whole["BSD-3-Clause"]), ("Apache-2.0", whole["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2019 C")), ("MPL-2.0", whole["MPL-2.0"]), ("GPL-3.0", whole["GPL-3.0"])]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [got[i]["license"] for i in range(len(rows))] == [n for n, _ in rows]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, (_, t) in enumerate(rows)])
    assert sorted(con.execute(licenses.scan_sql()).fetchall()) == sorted((i, r["digest"], r["n_canonical"], r["license"]) for i, r in got.items())


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op6_license_digests(spark, SF).select("doc_id", "digest", "n_canonical", "license").collect())
    assert got == sorted(con.execute(licenses.scan_sql()).fetchall())


PAGE = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body class="with-sidebar"><div id="cookie-banner">We use cookies</div>
<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="wrap">{free}</div><main><article><h2>A &amp; B</h2><p>One <b>two</b>
 three<p>Four<span class="share">Tweet</span> five<br>six<ul><li>x<li>y</ul><aside>also</aside><form><input>Send</form><section class="comments"><p>Nice</section></article></main>
<div class="site-footer">bye</div><footer>&copy; me</footer></body></html>"""


def test_html_blocks():
    found = html_text.blocks(PAGE.format(free="<p>Free text"))
    assert [t for t, w in found if w == html_text.ARTICLE] == ["A & B", "One two three", "Four five", "six", "x", "y"]
    assert [t for t, w in found if w == html_text.FREE] == ["Free text"]
    for torn in ("", "<", "a<b", "<p", "<p>x</", "&amp", "<!-- x", "<script>x", "x</p></div>y", "<p>a<p>b</p></p>"):
        html_text.blocks(torn)


def test_shared_lines():
    rng = np.random.default_rng(0)
    for bits in (1 << 30, 40):
        html_text.TABLE_BITS = bits
        for _ in range(60):
            a, b = rng.integers(0, 6, rng.integers(0, 25)).tolist(), rng.integers(0, 6, rng.integers(0, 25)).tolist()
            best = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
            got = sorted(html_text.shared(a, b))
            assert len(got) == best[-1, -1]
            it = iter(b)
            assert all(any(y == a[i] for y in it) for i in got)
    html_text.TABLE_BITS = 1 << 30


def test_html_differences(spark):
    free = lambda t: f"<body><p>Site line</p><p>{t}</p><div>Imprint</div></body>"
    rows = [
        (1, "http://h.org/a/1", free("first")), (2, "http://h.org/a/2", free("second")), (3, "http://h.org/a/2?x", free("second")), (4, "http://other.org/", free("alone")), (5, None, None), (6, "nonsense", ""),
        (7, "http://k.org/1", PAGE.format(free="same")), (8, "http://k.org/2", PAGE.format(free="same<p>new")), (8, "http://k.org/2", PAGE.format(free="same<p>new")),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string").repartition(4)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect())
    article = "A & B\nOne two three\nFour five\nsix\nx\ny"
    want = [(1, "first"), (2, "second"), (3, "Site line\nsecond\nImprint"), (4, "Site line\nalone\nImprint"), (5, ""), (6, ""), (7, article), (8, "new\n" + article), (8, "new\n" + article)]
    assert got == [(i, t, len(t)) for i, t in want]
    assert html_text.extract(df.where("false")).collect() == []


def test_pages_give_their_articles(spark):
    rows = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: r["text"] for r in queries.op7_html_differences(spark, SF).collect()}
    for i, page in rows:
        body = page[page.index("<article>"):page.find("</article>") if "</article>" in page else len(page)]
        words = re.sub(r"<[^>]*>", " ", body).replace("&amp;", "&").replace("&quot;", '"').split()
        assert got[i].split() == words


def test_hinge_model_is_optimal():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(80)]
    y = np.where([5 in r or 7 in r for r in rows], 1.0, -1.0)
    scale = quality_nbsvm.ratios(rows, y, 30)
    w, b = quality_nbsvm.fit_hinge(rows, scale, y, epochs=400)
    cost = np.where(y > 0, 40 / (y > 0).sum(), 40 / (y < 0).sum())
    z = np.array([(w[r] / np.sqrt(len(r))).sum() + b for r in rows])

    def loss(u, c):
        m = np.array([(scale[r] * u[r]).sum() / np.sqrt(len(r)) + c for r in rows])
        return 0.5 * (u @ u + c * c) + (cost * np.maximum(0, 1 - y * m)).sum()

    u = np.where(scale != 0, w / np.where(scale == 0, 1, scale), 0)
    base = loss(u, b)
    assert (np.sign(z) == y).mean() > 0.9
    assert all(base <= loss(u + 0.05 * rng.normal(size=30), b + 0.05 * rng.normal()) + 0.05 for _ in range(200))


def test_quality(spark):
    rows = queries.op8_quality_nbsvm(spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = np.array([s for s, q in held if q]), np.array([s for s, q in held if not q])
    assert (good[:, None] > bad).mean() > 0.97
    docs = spark.createDataFrame([(None, "a b", 1.0), (1, None, 0.0), (1, "", 0.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in quality_nbsvm.classify(docs, none).collect()] == [0.5] * 3
    assert quality_nbsvm.classify(docs.where("false"), none).collect() == []


def base(t):
    w = WORD.findall(t or "")
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_measures(docs, texts):
    rows = quality_rules.measures(docs).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows}
    assert got == {r[0]: base(r[1]) for r in texts}


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(k, n) for n in (1, 5, 40, 700) for k in (0, 1, 2, 5, 20) if k <= n]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    for p in (0.01, 0.05):
        for r in df.select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
            k, n = r["k"], r["n"]
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
            assert r["t"] == pytest.approx(want, rel=1e-8)


def test_certified_cutoffs(spark):
    rules = {"symbols": ("n_symbols / n_words", (1.0, 0.5, 0.2)), "marks": ("n_marks / n_words", (1.0, 0.1))}
    clean, ugly = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}##" for i in range(60))
    rows = [(i, clean + " " + " ".join("#" for _ in range(20 if i % 20 == 0 else 0)), "en" if i < 900 else None) for i in range(1000)] + [(2000, ugly, "en"), (2001, ugly, None), (None, ugly, "xx"), (2002, None, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1) for i in range(1000)] + [(5, 0), (2000, 0), (None, 1)], "doc_id bigint, quality int")
    cut = {(r["stratum"], r["rule"]): r for r in quality_rules.certify(quality_rules.measures(docs), labels, rules=rules, risk=0.04, error=0.05).collect()}
    # 45 of 900 good documents have 20 signs on 80 words: 0.25 is above 0.2 and too many for 2 %.
    assert cut["en", "symbols"]["level"] == 1 and cut["en", "symbols"]["n_good"] == 900 and cut["en", "symbols"]["n_rejected"] == 0
    assert cut[None, "symbols"]["level"] == -1  # 100 documents prove nothing at this level
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(quality_rules.measures(docs), quality_rules.certify(quality_rules.measures(docs), labels, rules=rules, risk=0.04), rules).collect()}
    assert out[2000] == (False, False) and out[2001] == (False, True) and out[None] == (False, True) and out[2002] == (True, False) and out[0] == (False, True)
    assert quality_rules.apply_rules(docs.where("false"), labels).collect() == []
    assert quality_rules.apply_rules(docs, labels.where("false")).where("kept").count() == 1003
