import hashlib
import random
import re
import zlib

import numpy as np

from geofold.llm import periodic


def brute(words):
    """All runs (start, length, period): maximal stretches of words p apart that are equal, smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j + p - i >= 12:
                found.setdefault((i, j + p - i), p)
            i = j
    return sorted((s, m, p) for (s, m), p in found.items())


def numbered(lists):
    names = {}
    return np.array([names.setdefault(w, len(names)) for ws in lists for w in ws], np.int64), np.array([len(ws) for ws in lists], np.int64)


def runs_of(lists):
    out = [[] for _ in lists]
    for t, s, m, p in zip(*(v.tolist() for v in periodic.find_runs(*numbered(lists)))):
        out[t].append((s, m, p))
    return out


def made(rnd):
    kind, n = rnd.randrange(5), rnd.randint(0, 160)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 20)
    if kind == 2:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a  # Fibonacci words are full of runs
        return list(b[:n])
    if kind == 3:
        out = []
        while len(out) < n:
            out += [rnd.choice("abcd") for _ in range(rnd.randint(1, 6))] * rnd.randint(1, 6)
        return out
    return (list("aab") * 5 + [rnd.choice("ab")]) * rnd.randint(1, 6)


def test_grammar_extensions():
    rnd = random.Random(2)
    for _ in range(20):
        lists = [made(rnd) for _ in range(6)]
        words, sizes = numbered(lists)
        walls = np.concatenate([np.cumsum(sizes + 1) - sizes - 1, [len(words) + len(sizes)]])
        letters = np.empty(len(words) + len(sizes) + 1, np.int64)
        letters[walls] = 100 + np.arange(len(walls))
        letters[np.setdiff1d(np.arange(len(letters)), walls)] = words
        levels = periodic.recompress(letters, walls)
        for x, y in zip(levels, levels[1:]):  # each level expands to the one below
            assert len(x.first) == len(y.letters) + 1 and len(x.parent) == len(x.letters)
        x = np.array([rnd.randrange(len(letters) - 1) for _ in range(300)])
        y = np.array([rnd.randrange(k + 1, len(letters)) for k in x])

        def brute_extension(s):
            out = []
            for i, j in zip(x.tolist(), y.tolist()):
                n = 0
                while j + n < len(s) and s[i + n] == s[j + n]:
                    n += 1
                out.append(n)
            return out

        assert periodic.extension(levels, x, y).tolist() == brute_extension(letters.tolist())
        assert periodic.extension(periodic.mirrored(levels), x, y).tolist() == brute_extension(letters[::-1].tolist())


def test_runs():
    rnd = random.Random(4)
    for _ in range(60):
        lists = [made(rnd) for _ in range(8)]
        assert runs_of(lists) == [brute(ws) for ws in lists]


def test_long_texts(monkeypatch):
    monkeypatch.setattr(periodic, "TABLE", 40)
    monkeypatch.setattr(periodic, "CANDIDATES", 30)
    monkeypatch.setattr(periodic, "remembered", lambda name, make: make())
    rnd = random.Random(6)
    for _ in range(40):
        lists = [made(rnd) for _ in range(4)] + [["a"] * 300, ["a"] * 150 + ["b"] + ["a"] * 150, list("abcab") * 60]
        assert runs_of(lists) == [brute(ws) for ws in lists]


def test_query(spark, docs, texts):
    rows = {r["doc_id"]: r for r in periodic.digests(docs).collect()}
    some = 0
    for i, t, *_ in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        r = rows[i]
        if n > 5000:  # brute force is quadratic
            assert r["n_runs"] >= (h % 10 == 0)
            continue
        runs = brute(words)
        some += len(runs)
        gone = {k for s, m, p in runs for k in range(s + p, s + m)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert some > 20


def test_edges(spark):
    again = "x y " * 10
    df = spark.createDataFrame([(None, None, 1), (None, again, 1), (None, again, 2), (2, "", 3), (3, " \n", 4)], "doc_id bigint, text string, runs int")
    got = sorted((r["n_words"], len(r["runs"]), r["collapsed"]) for r in periodic.detect(df).collect())
    assert got == [(0, 0, "")] * 3 + [(20, 1, "x y")] * 2
    assert periodic.digests(df).count() == 5 and periodic.digests(df.where("false")).collect() == []
