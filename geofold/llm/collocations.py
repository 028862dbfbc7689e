"""Phrase collocations by dynamic itemset counting: lengths are counted interleaved, in cyclic scans of shards.

Words are counted from the first shard on.  After each shard, phrases that have reached the threshold are marked; from
the next shard on, a phrase one word longer is counted where the two phrases inside it are marked.  A phrase is counted
for one full cycle of shards from when it is first met, so its count is exact; a length is closed when no more phrases
of it can begin and all have gone round.  Pairs are also held against hashed counts of all pairs, taken in a scan before: a
pair whose bucket is below the threshold cannot reach it and never begins.  Phrases are 128-bit codes while they are counted;
one more scan names the frequent ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from .common import released, stored

#: Fixed by the split: bytes that end a piece, and the mark they become (no byte of UTF-8).
ENDS, MARK = b".,;:!?\x0a\x0b\x0c\x0d", b"\xff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREPARE = bytes.maketrans(ENDS + UPPER.encode(), MARK * len(ENDS) + LOWER.encode())
#: Text of one language counted at once, and held in all, in bytes.
STEP_BYTES, HELD_BYTES = 2 << 20, 8 << 20
#: Bits of the marks of phrases that reached the threshold, at most (128 MB).  Beyond some 10^8 such phrases more phrases are
#: counted than need be; counts stay exact.
MARK_BITS = 1 << 30
#: Pairs hashed to one bucket on average, and buckets at most (bits of 128 MB; beyond some 10^10 pairs fewer are ruled out,
#: counts stay exact).  A block is the buckets whose counts are summed together.
LOAD, MOST_BUCKETS, BLOCK = 16, 1 << 30, 1 << 16
#: Buckets of pairs a task holds before it gives them out.
HELD_PAIRS = 1 << 22
#: Phrases a task remembers to have named.
TOLD = 1_000_000
#: One text in so many, chosen by hash, is asked first for the names of phrases; the others for what is left.
EARLY = 16
STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
CODE = ["length", "hi", "lo"]
COUNTS, NAMES = "length int, hi bigint, lo bigint, count bigint", "length int, hi bigint, lo bigint, lang string, phrase string"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _has(places: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Are the bits at these places set?"""
    return (bits[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1


def _marked(code: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Is each phrase marked?  ``bits`` are 64-bit words; two places a phrase."""
    last = np.uint64(64 * len(bits) - 1)
    ok = np.ones(len(code), bool)
    for place in (code & last, (code >> np.uint64(32)) & last):
        ok &= _has(place, bits)
    return ok


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Texts as numbers into their distinct words; number 0 is the mark between pieces."""
    data = b" ".join([MARK, MARK.join(texts).translate(PREPARE).replace(MARK, b" " + MARK + b" ")])
    # One long value; splitting at ASCII white space looks at bytes alone, and none but spaces and tabs are left.
    whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)])
    coded = pc.ascii_split_whitespace(whole).values.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    at = coded.indices.to_numpy().astype(np.int64)
    if b"" in names:
        at = at[at != names.index(b"")]
    return at, names


def word_codes(lang: str, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits of a language and of each word, as two numbers."""
    import xxhash

    words = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), np.uint64).reshape(-1, 2)
    return np.frombuffer(xxhash.xxh3_128_digest(lang.encode()), np.uint64), words


def phrases_of(lang: str, texts: list[bytes], bits: np.ndarray, heavy: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(length, high codes, low codes, counts, first places, numbers of words, words) of the phrases in some texts of one language.

    Length 0 is the number of words.  Phrases of two words and more are those whose two inner phrases are marked; a pair's
    bucket must be ``heavy``, too.
    """
    at, names = numbered(texts)
    seed, words = word_codes(lang, names)
    places = np.flatnonzero(at > 0)
    yield 0, seed[:1], seed[1:], np.array([len(places)]), np.zeros(1, np.int64), at, names
    begins = np.zeros(0, np.int64)  # of each place, the number of the marked phrase of the length that starts there, or -1
    for length in range(1, longest + 1):
        if length == 1:
            key = at[places]
        else:
            places = np.flatnonzero((begins[:-1] >= 0) & (begins[1:] >= 0))
            if length == 2:
                places = places[_has(_pair_buckets(seed, words, at, places, 64 * len(heavy)), heavy)]
            key = begins[places] * (int(begins.max(initial=0)) + 1) + begins[places + 1]
        if not len(places):
            break
        _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        first = places[first]
        code = []
        for side, step in enumerate(STEPS):
            c = np.full(len(first), seed[side])
            for r in range(length):
                c = c * step + words[at[first + r], side]
            code.append(_mixed(c))
        yield length, *code, counts, first, at, names
        begins = np.full(len(at) + 1, -1)
        begins[places] = np.where(_marked(code[1], bits)[inverse], inverse, -1)


def _pair_buckets(seed: np.ndarray, words: np.ndarray, at: np.ndarray, places: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the pair of words at each place."""
    code = (seed[:1] * STEPS[0] + words[at[places], 0]) * STEPS[0] + words[at[places + 1], 0]
    return _mixed(code) & np.uint64(buckets - 1)


def _parts(it) -> Iterator[tuple[str, list[bytes]]]:
    """Bounded parts of texts of one language."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in it:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            data = text.as_py().encode()
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= STEP_BYTES:
                size.pop(lang)
                yield lang, held.pop(lang)
            elif len(size) > 4 and sum(size.values()) >= HELD_BYTES:
                yield from held.items()
                held, size = {}, {}
    yield from held.items()


def heavy_buckets(texts: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bits of the buckets of pairs that hold ``least`` occurrences in all; pairs are those of any words next to each other.

    A task gives sorted buckets with their counts (to ``least``), as bytes for each block; a block's counts are summed in
    an array of its own, and only its bits (``buckets`` / 8 bytes in all) reach the driver.
    """
    kind, block = np.min_scalar_type(least), min(BLOCK, buckets)

    def count(it) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def give() -> Iterator[pa.RecordBatch]:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            number = found // block
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(found)]
            rest, counts = (found % block).astype("<u2"), np.minimum(counts, least).astype(kind)
            rows = [(int(number[a]), rest[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 256]), (pa.int64(), pa.binary(), pa.binary()))], ["block", "places", "counts"])

        for lang, part in _parts(it):
            at, names = numbered(part)
            seed, words = word_codes(lang, names)
            places = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
            if len(places):
                held.append(_pair_buckets(seed, words, at, places, buckets).astype(np.uint32))
            if sum(map(len, held)) >= HELD_PAIRS:
                yield from give()
        if held:
            yield from give()

    def total(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(block, np.int64)
        for pdf in batches:
            for places, counts in zip(pdf["places"], pdf["counts"]):
                sums[np.frombuffer(places, "<u2")] += np.frombuffer(counts, kind)
        yield pd.DataFrame({"block": [key[0]], "bits": [np.packbits(sums >= least, bitorder="little").tobytes()]})

    total.__annotations__ = {"key": tuple[Any, ...], "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    found = texts.select("lang", "text").mapInArrow(count, "block bigint, places binary, counts binary").groupBy("block").applyInPandas(total, "block bigint, bits binary").toArrow()
    heavy = np.zeros((buckets // block, block // 8), np.uint8)
    for number, bits in zip(found["block"].to_pylist(), found["bits"].to_pylist()):
        heavy[number] = np.frombuffer(bits, np.uint8)
    return heavy.reshape(-1).view(np.uint64)


def _scan(texts: DataFrame, bits, heavy, longest: int, schema: str, tell) -> DataFrame:
    """What ``tell`` gives for the phrases of each bounded part of the texts (``lang``, ``text``), as rows of ``schema``.

    It gets a set that lasts for the task."""
    def run(it) -> Iterator[pa.RecordBatch]:
        marks, pairs = np.frombuffer(bits.value, np.uint64), np.frombuffer(heavy.value, np.uint64)
        told: set[int] = set()
        for lang, part in _parts(it):
            for found in phrases_of(lang, part, marks, pairs, longest):
                yield from tell(told, lang, marks, *found)

    return texts.select("lang", "text").mapInArrow(run, schema)


def _codes(length: int, hi: np.ndarray, lo: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.full(len(hi), length, "i4")), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))]


def _counts(texts: DataFrame, bits, heavy, closed: int, longest: int) -> DataFrame:
    """Counts of phrases of the lengths that are not closed, several rows a phrase; numbers of words until words are."""
    def tell(told, lang, marks, length, hi, lo, counts, first, at, names) -> Iterator[pa.RecordBatch]:
        if length > closed or not (length or closed):
            yield pa.RecordBatch.from_arrays([*_codes(length, hi, lo), pa.array(counts.astype(np.int64))], [*CODE, "count"])

    return _scan(texts, bits, heavy, longest, COUNTS, tell)


def _names(texts: DataFrame, bits, asked, heavy, longest: int) -> DataFrame:
    """Codes, language and words of the marked phrases that are ``asked`` for (bits as the marks), and of the languages."""
    def tell(told, lang, marks, length, hi, lo, counts, first, at, names) -> Iterator[pa.RecordBatch]:
        which = np.flatnonzero(_marked(lo, np.frombuffer(asked.value, np.uint64))) if length else np.zeros(1, np.int64)
        # A task names a phrase once; past TOLD it may do so again.
        which = which[np.array([c not in told for c in (lo[which] ^ hi[which]).tolist()], bool)]
        if len(told) > TOLD:
            told.clear()
        told.update((lo[which] ^ hi[which]).tolist())
        words = [b" ".join(names[w] for w in at[i:i + length].tolist()).decode() for i in first[which].tolist()]
        yield pa.RecordBatch.from_arrays([*_codes(length, hi[which], lo[which]), pa.array([lang] * len(which), pa.string()), pa.array(words, pa.string())], [*CODE, "lang", "phrase"])

    return _scan(texts, bits, heavy, longest, NAMES, tell).distinct()


def _mark(marks: np.ndarray, low: DataFrame) -> None:
    """Set the marks of codes ``lo``; they are gathered as words of bits, ``MARK_BITS`` at most."""
    last = 64 * len(marks) - 1
    place = F.explode(F.array(F.col("lo").bitwiseAND(last), F.shiftrightunsigned("lo", 32).bitwiseAND(last)))
    bits = low.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    found = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    marks[found["w"].to_numpy()] |= found["b"].to_numpy().view(np.uint64)


def frequent_phrases(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, shards: int = 2) -> DataFrame:
    """(lang, length, phrase, count) of phrases of up to ``longest`` words that occur ``least`` times in their language.

    A row of length 0 has the number of all words of a language.  Texts are dealt to ``shards`` by a hash of key and
    text.  Only bits of marks and buckets (both bounded) and a few numbers reach the driver.
    """
    spark = docs.sparkSession
    early = F.pmod(F.xxhash64(text, key), F.lit(EARLY)) == 0
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(F.xxhash64(key, text), F.lit(shards)).cast("int").alias("shard"), early.cast("int").alias("early"))
    held = stored(rows.where(F.length("text") > 0), "shard", "early")
    size = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = np.zeros(1 << max(10, min(MARK_BITS.bit_length() - 7, math.ceil(math.log2(size + 1)) - 8)), np.uint64)
    # A pair takes two words and four bytes at the least.
    buckets = 1 << max(10, min(MOST_BUCKETS.bit_length() - 1, math.ceil(math.log2(size // (4 * LOAD) + 1))))
    heavy = spark.sparkContext.broadcast(heavy_buckets(held, buckets, least).tobytes())
    closed, latest, step, parts, last = 0, {}, 0, [], None
    state = spark.createDataFrame([], COUNTS + ", since int")
    zero = F.lit(0).cast("bigint")
    while closed < longest:
        bits = spark.sparkContext.broadcast(marks.tobytes())
        new = _counts(held.where(F.col("shard") == step % shards), bits, heavy, closed, longest)
        both = state.select(*CODE, "since", F.col("count").alias("old"), zero.alias("more")).unionByName(
            new.select(*CODE, F.when(F.col("length") > 1, step).otherwise(0).alias("since"), zero.alias("old"), F.col("count").alias("more")))
        met = both.groupBy(*CODE).agg(F.min("since").alias("since"), F.sum("old").alias("old"), F.sum("more").alias("more"))
        count = F.col("old") + F.when(F.col("since") + shards > step, F.col("more")).otherwise(0)
        fresh = (F.col("length") > 0) & (F.col("old") < least) & (count >= least)
        now = stored(met.select(*CODE, "since", count.alias("count"), fresh.alias("fresh")))
        bits.destroy()
        lengths = [r["length"] for r in now.where("fresh").select("length").distinct().collect()]  # one row a length
        latest |= dict.fromkeys(lengths, step)
        if lengths:
            _mark(marks, now.where("fresh"))
        before = closed
        while closed < longest and (step >= shards - 1 if closed == 0 else step >= latest.get(closed, -shards) + shards):
            closed += 1
        if closed > before:
            done = (F.col("length") > (before or -1)) & (F.col("length") <= closed) & ((F.col("length") == 0) | (F.col("count") >= least))
            parts.append(stored(now.where(done).select(*CODE, "count")))
        if last is not None:
            released(last)
        last, state, step = now, now.where(F.col("length") > (closed or -1)), step + 1
    bits = spark.sparkContext.broadcast(marks.tobytes())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = stored(_names(held.where("early = 1"), bits, bits, heavy, longest))
    left = np.zeros_like(marks)
    _mark(left, out.join(names, CODE, "left_anti"))
    asked = spark.sparkContext.broadcast(left.tobytes())
    if left.any():  # each frequent phrase that the early texts lack is in one of the others
        names = stored(names.unionByName(_names(held.where("early = 0"), bits, asked, heavy, longest)).distinct())
    for kept in (bits, asked, heavy):
        kept.destroy()
    released(last, held)
    return out.join(names, CODE).select("lang", "length", "phrase", "count")


def mine(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, shards: int = 2, part_rows: int = 500_000) -> DataFrame:
    """lang, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language by their weakest cut.

    Texts are lower-cased (A-Z), split at stops and line ends into pieces, and those at spaces and tabs into words; a
    phrase lies within a piece and counts each time it occurs.  A cut into the first k words (``l`` times) and the rest
    (``r`` times) scores floor(1000 a n / (l r)); the lowest score counts, the smallest k of equal ones.  Phrases inside a
    phrase one word longer that is as frequent are dropped (one inside a longer phrase is also inside those between).
    Ties of score go by ``a``, then by the phrase's bytes.

    Phrases are counted by 128-bit codes of language and words.  Null texts are empty; a null language is ``und``.  Repeated rows count as often as they stand; other columns are not
    read; an empty table gives no rows.  Hot parts of phrases and hot languages are salted, and ranks are cut in
    parts of a language before they meet.
    """
    found = frequent_phrases(docs, key, text, lang, least, longest, shards)
    phrases = stored(found.where("length > 0"))
    total = found.where("length = 0").select("lang", F.col("count").alias("n"))
    known = phrases.select("lang", "phrase", "count")
    inner = F.split("phrase", " ")
    shorter = F.explode(F.array(F.array_join(F.slice(inner, F.lit(1), F.col("length") - 1), " "), F.array_join(F.slice(inner, F.lit(2), F.col("length") - 1), " ")))
    wider = phrases.where("length > 2").select("lang", shorter.alias("phrase"), "count").groupBy("lang", "phrase").agg(F.max("count").alias("_wide"))
    kept = phrases.where("length > 1").join(wider, ["lang", "phrase"], "left").where(F.col("_wide").isNull() | (F.col("_wide") < F.col("count")))
    kept = salted_join(kept.select("lang", "phrase", "length", F.col("count").alias("a")), total, ["lang"], ["phrase"])
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = stored(cuts.withColumn("_head", F.array_join(F.slice(inner, F.lit(1), F.col("k")), " ")).withColumn("_tail", F.array_join(F.slice(inner, F.col("k") + 1, F.col("length")), " ")))
    cuts = salted_join(cuts, known.select("lang", F.col("phrase").alias("_head"), F.col("count").alias("l")), ["lang", "_head"], ["phrase", "k"])
    cuts = salted_join(cuts, known.select("lang", F.col("phrase").alias("_tail"), F.col("count").alias("r")), ["lang", "_tail"], ["phrase", "k"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    scored = stored(cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best")).select("lang", "phrase", "a", "n", "_best.score", "_best.l", "_best.r"))
    salts = max(1, -(-scored.count() // part_rows))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = scored.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_r") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def mine_sql() -> str:
    """The same over ``documents`` in DuckDB, by counting every phrase."""
    return f"""
with pieces as (
  select lang, row_number() over () as id, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)
), places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from pieces
), grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as k from places)
), counts as (
  select lang, k, phrase, count(*) as f from grams group by all
), total as (
  select lang, sum(f)::bigint as n from counts where k = 1 group by lang
), candidates as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from counts where k >= 2 and f >= 100
), inside as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as wide
  from (select lang, w, a, m, unnest(range(1, k - m + 2)) as i from (select lang, k, w, a, unnest(range(2, k)) as m from candidates where k > 2)) group by all
), kept as (
  select c.* from candidates c left join inside x on x.lang = c.lang and x.phrase = c.phrase where x.wide is null or x.wide < c.a
), parts as (
  select lang, phrase, a, j, array_to_string(w[1:j], ' ') as head, array_to_string(w[j + 1:k], ' ') as tail from (select lang, k, phrase, a, w, unnest(range(1, k)) as j from kept)
), cuts as (
  select p.lang, p.phrase, p.a, l.f as l, r.f as r, t.n, j, (1000::hugeint * p.a * t.n // (l.f::hugeint * r.f))::bigint as score
  from parts p join counts l on l.lang = p.lang and l.phrase = p.head join counts r on r.lang = p.lang and r.phrase = p.tail join total t on t.lang = p.lang
), best as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from best
qualify rank <= 2000"""
