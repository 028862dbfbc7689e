"""Quality rules whose cutoffs are certified on labelled holdouts: exact binomial tests, corrected for their number."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, stored

BLANK = r"[\x20\x09-\x0D]+"
#: Each rule rejects a document whose measure is above the cutoff; cutoffs run from loose to tight and are fixed beforehand.
RULES: dict[str, tuple[str, Sequence[float]]] = {
    "symbols": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "repeats": ("n_repeat_words / n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "shouting": ("n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    "marks": ("n_marks / n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2)),
    "word_length": ("word_chars / n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0)),
}


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """key, stratum and counts of every whole text; nothing is shuffled.

    A null or empty text has no words and zero counts.  Repeated windows are found by sorting a text's own windows, in
    n log n steps.  The windows' 64-bit hashes stand for them.
    """
    df = docs.select(F.col(key).alias("_id"), F.col(stratum).cast("string").alias("_stratum"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    # inline() keeps the words from being extracted anew in each expression that uses them.
    words, lines = F.regexp_extract_all("_text", F.lit(f"({WORD})"), 1), F.filter(F.split("_text", "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    df = df.select("*", F.inline(F.array(F.struct(words.alias("_words"), lines.alias("_lines")))))
    n = F.size("_words")
    many = F.greatest(n - 2, F.lit(0))
    triples = F.arrays_zip(*[F.slice("_words", i, many) for i in (1, 2, 3)])
    windows = F.array_sort(F.transform(triples, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("p"))))
    df = df.select("_id", "_stratum", "_text", n.cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
                   (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.inline(F.array(F.struct(windows.alias("_windows")))))
    pairs = F.greatest(F.size("_windows") - 1, F.lit(0))
    twice = F.zip_with(F.slice("_windows", 1, pairs), F.slice("_windows", 2, pairs), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")))
    df = df.select("*", F.inline(F.array(F.struct(F.array_sort(F.array_distinct(F.flatten(twice))).alias("_at")))))
    more = F.greatest(F.size("_at") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("_at", 1, more), F.slice("_at", 2, more), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x) + F.when(F.size("_at") > 0, 3).otherwise(0)
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("long")
    return df.select(
        F.col("_id").alias(key), F.col("_stratum").alias("stratum"), "n_words", F.length(F.regexp_replace("_text", BLANK, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"), "n_dup_lines", covered.cast("long").alias("n_repeat_words"),
        "n_lines", count(r"\p{Lu}").alias("n_upper"), count(r"[!?]").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight places up, brought down by the product of the steps; about 1e-12 for x >= 1."""
    z, steps = x + 8, F.lit(0.0)
    for i in range(8):
        steps = steps + F.ln(x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed down from k; terms past twelve deviations are bounded by a geometric rest.

    The bound makes it an upper bound, by less than 1e-12.  1 where k is at or above the mean, or n is 0.
    """
    k, n = k.cast("double"), n.cast("double")
    log_term = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  of the term at i - 1 to the one at i
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 50).cast("int")
    start = F.struct(F.lit(1.0).cast("double").alias("t"), F.lit(1.0).cast("double").alias("s"))
    done = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>")), start,
        lambda a, i: F.struct((a["t"] * ratio(k - i)).alias("t"), (a["s"] + a["t"] * ratio(k - i)).alias("s")),
    )
    low = k - steps
    rest = F.when(low > 0, done["t"] * ratio(low) / (1 - ratio(low))).otherwise(0.0)
    tail = F.exp(log_term) * (done["s"] + rest)
    return F.when((n > 0) & (k < n * p), F.least(tail, F.lit(1.0))).otherwise(1.0)


def _first_level(measure: str, cutoffs: Sequence[float]) -> Column:
    """The loosest cutoff (its number) that rejects the document; their count if none does or the measure is undefined."""
    value = F.expr(f"try_divide(double({measure.split(' / ')[0]}), double({measure.split(' / ')[1]}))")
    return F.lit(len(cutoffs)) - sum((F.coalesce(value > c, F.lit(False)).cast("int") for c in cutoffs), F.lit(0))


def certify(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", risk: float = 0.05, error: float = 0.05,
            rules: dict[str, tuple[str, Sequence[float]]] = RULES) -> DataFrame:
    """(stratum, rule, cutoff, level, n_good, n_rejected, p_value): the tightest certified cutoff of each rule and stratum.

    ``risk`` bounds the share of good documents that all rules together may reject in a stratum; each rule gets an
    equal part of it.  The cutoffs of a rule are tested from loose to tight until one fails (so they need no
    correction among themselves), each test at ``error`` / (rules x strata).  With probability 1 - ``error`` every
    bound holds.  Labels other than 1 and documents that the base rules fail take no part; a document labelled
    twice counts once, by its largest label.  A rule without a certified cutoff has level -1 and rejects nothing.
    """
    of = free_name(measured, "_of")
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(of)).agg(F.max(label).alias("_label")).where(F.col("_label") == 1).select(of)
    rows = measured.where(~base_failed()).join(good, measured[key] == F.col(of), "left_semi")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), _first_level(m, c).alias("first")) for n, (m, c) in rules.items()]))
    counts = rows.select("stratum", each.alias("_e")).groupBy("stratum", "_e.rule", "_e.first").agg(F.count(F.lit(1)).alias("n"))
    # One row a stratum, rule and level from here on.
    ladder = F.create_map(*[x for n, (_, c) in rules.items() for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in c]))])
    totals = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"), F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("_at"))
    totals = totals.withColumn("_cutoffs", F.element_at(ladder, F.col("rule")))
    totals = totals.withColumn("_tests", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    levels = totals.select("*", F.posexplode("_cutoffs").alias("level", "cutoff"))
    rejected = F.aggregate(F.map_entries("_at"), F.lit(0).cast("long"), lambda a, e: a + F.when(e["key"] <= F.col("level"), e["value"]).otherwise(0))
    levels = levels.withColumn("n_rejected", rejected).withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk / len(rules)))
    so_far = Window.partitionBy("stratum", "rule").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("_ok", F.min((F.col("p_value") <= F.lit(error) / F.col("_tests")).cast("int")).over(so_far) == 1)
    best = F.max(F.when(F.col("_ok"), F.struct("level", "cutoff", "n_rejected", "p_value")))
    levels = levels.groupBy("stratum", "rule").agg(best.alias("_b"), F.first("n_good").alias("n_good"))
    return levels.select("stratum", "rule", "_b.cutoff", F.coalesce("_b.level", F.lit(-1)).alias("level"), "n_good", "_b.n_rejected", "_b.p_value")


def judge(measured: DataFrame, cutoffs: DataFrame, rules: dict[str, tuple[str, Sequence[float]]] = RULES) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``rejected_by`` (rule names).  A stratum without cutoffs keeps what passes the base rules."""
    # One row a stratum.
    per = cutoffs.groupBy(F.coalesce(F.concat(F.lit("s"), "stratum"), F.lit("n")).alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "level"))).alias("_levels"))
    df = measured.withColumn("_k", F.coalesce(F.concat(F.lit("s"), "stratum"), F.lit("n"))).join(F.broadcast(per), "_k", "left")
    hits = [F.when(_first_level(m, c) <= F.element_at("_levels", F.lit(n)), F.lit(n)) for n, (m, c) in rules.items()]
    df = df.withColumn("rejected_by", F.array_compact(F.array(*hits))).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_k", "_levels")


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality", **options) -> DataFrame:
    """Measure, certify and judge: one row per row of ``docs`` (null keys and repeated rows included).

    Without labels every rule is off and only the base rules reject.  An empty table gives an empty result.
    """
    measured = stored(measures(docs, key, text, stratum))
    return judge(measured, stored(certify(measured, labels, key, label, **options)))
