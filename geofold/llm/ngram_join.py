"""Jaccard join on word n-grams with adaptive prefixes: a longer prefix asks for more shared tokens before a pair is verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spatial_join import components
from .common import batches, released, stored

#: Cost of verifying a pair against that of one row of an inverted list.
VERIFY = 20.0
#: Leaders of a token's documents, each chosen by a seeded hash; all of its documents are compared with them first.
LEADERS = 6
#: A token whose open pairs are more than this is compared in blocks of about so many tokens of sets.
PAIRS, BLOCK = 1_000, 400_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of a text's word n-grams; A-Z are lower-cased, words are split at ASCII white space.

    Fewer words than ``width`` are one n-gram; without words the set is empty.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(len(w) - width + 1, 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for i in range(min(width, len(w))):
        h = (h ^ w[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any set at least that similar."""
    return -(-percent * n // 100)


def longest(n: int) -> int:
    """The longest prefix a set of ``n`` may take, in tokens asked for."""
    return max(1, n // 10)


def sets(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``_id``, ``_text_code``, ``n``, ``_set`` (128-bit digest of the whole set) and ``_head``: the tokens of its longest prefix in code order."""
    import xxhash  # noqa: F401  needed where the tasks run, too

    df = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_text_code"), F.col(text).cast("string").alias("_text"))

    def build(cols) -> Iterator[pa.RecordBatch]:
        import xxhash

        n, code, head = [], [], []
        for t in cols["_text"]:
            s = shingles(t.as_py(), width)
            n.append(len(s))
            code.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            head.append(s[:len(s) - least_overlap(len(s), percent) + longest(len(s))])
        yield pa.RecordBatch.from_arrays([cols["_id"], cols["_text_code"], pa.array(n, pa.int64()), pa.array(code, pa.string()), pa.array(head, pa.list_(pa.int64()))], ["_id", "_text_code", "n", "_set", "_head"])

    return batches(df, build, f"_id {docs.schema[key].dataType.simpleString()}, _text_code bigint, n bigint, _set string, _head array<bigint>")


def possible(found: DataFrame, percent: int) -> DataFrame:
    """Classes that may have a partner: ``_set``, ``id`` (a number of its own) and a row with that set (``rep``, ``_text_code``).

    In code order, a set and its partner share at least l tokens among the first n - overlap + l of each, for every l.
    So l of a set's own must stand in another set's prefix; l is the most that its smallest partner's prefix allows.
    """
    # Every class keeps one prefix; equal sets have equal ones, so any row of the class will do.
    # The row with the smallest key stands for it; keys may be null, then any row does.
    classes = found.where("n > 0").groupBy("_set").agg(
        F.min("_id").alias("rep"), F.coalesce(F.min_by("_text_code", "_id"), F.min("_text_code")).alias("_text_code"), F.first("n").alias("n"), F.first("_head").alias("_head"))
    # A number stands for the class in the many rows of its tokens.
    heads = stored(classes.withColumn("_code", F.xxhash64("_set")))
    overlap = F.ceil(F.col("n") * percent / 100)
    asked = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    common = heads.select(F.explode("_head").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1").select("_token")
    near = heads.select("_code", F.explode(F.slice("_head", F.lit(1), (F.col("n") - overlap + asked).cast("int"))).alias("_token"))
    counts = near.join(common, "_token", "left_semi").groupBy("_code").agg(F.count(F.lit(1)).alias("_c"))
    left = heads.join(counts, "_code").where(F.col("_c") >= asked).select("_set", "_code", "rep", "_text_code")
    # Two classes with one code get two numbers.
    number = F.col("_code") + F.row_number().over(Window.partitionBy("_code").orderBy("_set")) - 1
    out = stored(left.select("_set", number.alias("id"), "rep", "_text_code"))
    released(heads)
    return out


def whole_sets(docs: DataFrame, reps: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``_set``, ``id``, ``n``, ``tokens``: the whole sets of the classes, built again from their rows' texts.

    Rows are found by key and text code, as keys may be null or repeated; the set is compared all the same.
    """
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_code"), F.col(text).cast("string").alias("_text"))
    df = rows.join(reps, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_code") == F.col("_text_code"))).select("_set", "id", "_text")

    def build(cols) -> Iterator[pa.RecordBatch]:
        import xxhash

        found = [shingles(t.as_py(), width) for t in cols["_text"]]
        keep = [i for i, (s, code) in enumerate(zip(found, cols["_set"])) if xxhash.xxh3_128_hexdigest(s.tobytes()) == code.as_py()]
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([cols["_set"].take(at), cols["id"].take(at), pa.array([len(found[i]) for i in keep], pa.int64()), pa.array([found[i] for i in keep], pa.list_(pa.int64()))], ["_set", "id", "n", "tokens"])

    return batches(df, build, "_set string, id bigint, n bigint, tokens array<bigint>").dropDuplicates(["_set"])


def choose(dfs: np.ndarray, n: int, percent: int) -> int:
    """Tokens to ask for, so that the estimated cost is least: rows read in the prefix's lists, and pairs to verify.

    ``dfs`` are the sorted list lengths of the set's shared tokens; the others come first and cost nothing.  With l
    tokens asked for, a pair takes l of the rows read, so at most rows / l pairs are left.  0 if no partner is possible.
    """
    alone, overlap = n - len(dfs), least_overlap(n, percent)
    if n - alone < overlap:
        return 0
    asked = np.arange(1, longest(n) + 1)
    read = np.concatenate([[0.0], np.cumsum(dfs - 1.0)])[np.clip(n - overlap + asked - alone, 0, len(dfs))]
    return int(asked[(read * (1 + VERIFY / asked)).argmin()])


def prefixes(full: DataFrame, percent: int) -> DataFrame:
    """(_token, id, n, asked, alone, short): the adaptive prefix of each set, rarest tokens first, without tokens of one set only.

    ``alone`` counts the set's tokens that no other has; ``short`` marks those of the prefix that asks for one token.
    """
    tokens = full.select("id", F.explode("tokens").alias("_token"))
    common = tokens.groupBy("_token").agg(F.count(F.lit(1)).cast("int").alias("_df")).where("_df > 1")
    lists = tokens.join(common, "_token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_t"))
    lists = lists.join(full.select("id", "n"), "id")
    kind = full.schema["id"].dataType.simpleString()

    def cut(cols) -> Iterator[pa.RecordBatch]:
        ids, ns, asked, token, alone, short = [], [], [], [], [], []
        for i, (n, t) in enumerate(zip(cols["n"].to_pylist(), cols["_t"])):
            flat = t.values
            dfs = flat.field("_df").to_numpy()
            want = choose(dfs, n, percent)
            if want:
                take = max(0, n - least_overlap(n, percent) + want - (n - len(dfs)))
                codes = flat.field("_token").to_numpy()[:take]
                token.append(codes)
                ids += [i] * len(codes)
                ns += [n] * len(codes)
                asked += [want] * len(codes)
                alone += [n - len(dfs)] * len(codes)
                short.append(np.arange(len(codes)) < n - least_overlap(n, percent) + 1 - (n - len(dfs)))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token), pa.int64()), cols["id"].take(pa.array(ids, pa.int64())), pa.array(ns, pa.int64()), pa.array(asked, pa.int64()), pa.array(alone, pa.int64()), pa.array(np.concatenate(short))], ["_token", "id", "n", "asked", "alone", "short"])

    return batches(lists, cut, f"_token bigint, id {kind}, n bigint, asked bigint, alone bigint, short boolean")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough."""
    left = full.select(F.col("id").alias("a"), F.col("tokens").alias("_ta"))
    right = full.select(F.col("id").alias("b"), F.col("tokens").alias("_tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("_both", F.size(F.array_intersect("_ta", "_tb")))
    return both.where(100 * F.col("_both") >= percent * (F.size("_ta") + F.size("_tb") - F.col("_both"))).select("a", "b")


def _in_blocks(heavy: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the documents of each heavy token, one per document and other component.

    ``heavy``: _token, id, component, _lead (outside the token's largest component).  Leading documents are dealt to
    blocks, all documents to others, and each pair of blocks is one task's work, which counts shared tokens through
    sorted postings and gives out no pairs but links.
    """
    rows = heavy.join(full.select("id", "n", "tokens"), "id")
    sizes = heavy.join(full.select("id", "n"), "id").groupBy("_token").agg(
        F.ceil(F.sum(F.when(F.col("_lead"), F.col("n")).otherwise(0)) / BLOCK).alias("_nl"), F.ceil(F.sum("n") / BLOCK).alias("_nr"))
    rows = rows.join(sizes, "_token")
    h = F.xxhash64("id")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = rows.where("_lead").withColumn("_i", F.pmod(h, F.col("_nl"))).withColumn("_j", spread("_nr"))
    right = rows.withColumn("_j", F.pmod(h, F.col("_nr"))).withColumn("_i", spread("_nl")).withColumn("_lead", F.lit(False))
    both = left.unionByName(right).select("_token", "_i", "_j", "_lead", "id", "component", "tokens")
    names = full.schema["id"].dataType

    def compare(t: pa.Table) -> pa.Table:
        lead = t["_lead"].combine_chunks().to_numpy(zero_copy_only=False)
        place = t["id"].combine_chunks()
        part = np.unique(np.array(t["component"].to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        lists = t["tokens"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
        codes = lists.flatten().to_numpy()
        a, b = np.flatnonzero(lead), np.flatnonzero(~lead)
        owner = np.repeat(np.arange(len(b)), ends[b + 1] - ends[b])
        flat = np.concatenate([codes[ends[k]:ends[k + 1]] for k in b]) if len(b) else codes[:0]
        order = np.argsort(flat, kind="stable")
        flat, owner, size = flat[order], owner[order], ends[b + 1] - ends[b]
        found = []
        for k in a if len(b) else ():
            mine = codes[ends[k]:ends[k + 1]]
            lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
            many = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(b))
            near = np.flatnonzero((100 * both >= percent * (len(mine) + size - both)) & (part[b] != part[k]))
            found += [(k, b[x]) for x in near[np.unique(part[b[near]], return_index=True)[1]]]
        ka, kb = (pa.array([p[i] for p in found], pa.int64()) for i in (0, 1))
        return pa.table({"a": place.take(ka), "b": place.take(kb)})

    return both.groupBy("_token", "_i", "_j").applyInArrow(compare, f"a {names.simpleString()}, b {names.simpleString()}").distinct()


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``_id``, ``_set``, ``n`` per row; ``_set``, ``id`` of classes that may have links; stored links between classes that
    give the same components as all links).

    Classes sharing a token are first compared with a few leaders of that token, chosen by seeded hashes; what
    is joined by those links needs no further pair; the first leader is the one with the fewest tokens of its own, which
    in a group of edited copies is their middle.  Then all pairs that lie in different components and share enough
    prefix tokens are verified, those of tokens with many such pairs in blocks, so no connection is lost and a large
    group of near copies is never paired out.
    """
    raw = stored(sets(docs, key, text, width, percent))
    found, reps = stored(raw.drop("_head", "_text_code")), possible(raw, percent)
    released(raw)
    whole = stored(whole_sets(docs, reps, key, text, width))
    full = whole.drop("_set")
    index = stored(prefixes(full, percent))
    seeded = [F.min(F.struct(*([F.col("alone")] if s == 0 else []), F.xxhash64("id", F.lit(s)).alias("h"), F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("asked").alias("_qb"))).alias(f"_l{s}") for s in range(LEADERS)]
    leaders = index.groupBy("_token").agg(*seeded)
    leaders = leaders.select("_token", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"_l{s}.{c}").alias(c) for c in ("b", "_nb", "_qb")]) for s in range(LEADERS)]))).alias("_l")).select("_token", "_l.*")
    mine = index.select("_token", F.col("id").alias("a"), F.col("n").alias("_na"), F.col("asked").alias("_qa"))
    # A leader leads its documents in some of their tokens only, so one shared token is enough to look at it.
    led = mine.join(leaders, "_token").where(F.col("a") != F.col("b"))
    fits = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
    first = led.where(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_c")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = stored(verified(first, full, percent))
    part = components(full.select("id"), near, "id")
    placed = stored(index.join(part, "id"))
    # Only tokens of two components or more are left, and of a token's rows those outside its largest component lead.
    sizes = placed.groupBy("_token", "component").agg(F.count(F.lit(1)).alias("_k"))
    most = sizes.groupBy("_token").agg(F.max_by("component", F.struct("_k", "component")).alias("_most"), F.max("_k").alias("_large"), F.sum("_k").alias("_all")).where("_all > _large")
    open_ = stored(placed.join(most, "_token").withColumn("_lead", F.col("component") != F.col("_most")).withColumn("_heavy", (F.col("_all") - F.col("_large")) * F.col("_all") > PAIRS))
    heavy = _in_blocks(open_.where("_heavy and short").select("_token", "id", "component", "_lead"), full, percent)
    # A pair that shares no heavy token of its short prefixes shares a light one there; heavy ones beyond may be shared, too.
    beyond = open_.where("_heavy").groupBy("id").agg(F.count(F.lit(1)).alias("_far"))
    light = open_.where("not _heavy").join(beyond, "id", "left").withColumn("_far", F.coalesce("_far", F.lit(0)))
    side = lambda c: light.select("_token", F.col("id").alias(c), F.col("n").alias(f"_n{c}"), F.col("asked").alias(f"_q{c}"), F.col("_far").alias(f"_f{c}"), F.col("component").alias(f"_c{c}"), F.col("_lead").alias(f"_l{c}"))
    rows = side("a").where("_la").join(side("b"), "_token").where((F.col("_ca") != F.col("_cb")) & (~F.col("_lb") | (F.col("a") < F.col("b"))))
    # Which side leads changes from token to token, so a pair's tokens are counted in one order of its ids.
    pairs = rows.where(fits).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("_c"), F.first(F.least("_qa", "_qb") - F.least("_fa", "_fb")).alias("_q")).where("_c >= _q").select("a", "b")
    rest = verified(pairs, full, percent).unionByName(heavy)
    both = stored(near.unionByName(rest))
    released(whole, index, near, placed, open_)
    return found, reps, both


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """key, ``n_shingles``, ``component_id`` (smallest key reachable by links) and ``n_verified`` (links of its class that were needed to join its component).

    One row per row of ``docs``.  Equal sets are one class, which has a number of its own, and never paired.  A null or
    empty text has an empty set and is its own component.  A null key links as any other, but gives its component no
    name: without other keys in it the component is null.  Of repeated keys the rows stay, each by its own text.
    Words are compared by 64-bit codes and whole sets by 128-bit ones.  An empty table gives none; other
    columns are not read.
    """
    found, numbers, pairs = links(docs, key, text, width, percent)
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    part = components(ends.distinct(), pairs, "id")
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_verified"))
    least = found.where("n > 0").groupBy("_set").agg(F.min("_id").alias("_least"))
    linked = numbers.select("_set", "id").join(part, "id").join(degree, "id").join(least, "_set")
    named = linked.groupBy("component").agg(F.min("_least").alias("_name"))
    linked = linked.join(named, "component").select("_set", "_name", "n_verified")
    classes = least.join(linked, "_set", "left").select("_set", F.coalesce("_name", "_least").alias("_component"), "n_verified")
    out = found.join(classes, "_set", "left")
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("_component", "_id").alias("component_id"), F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"))
