"""A corpus from raw documents: language, near copies, repeated passages, mix of sources, packed windows."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import geofold
from geofold.llm import language, mixing, ngram_join, packing, suffix_dedup
from geofold.llm.common import fold, free_name, stored, table

# Workers get the package's functions by value, so it need not be installed where they run.
cloudpickle.register_pickle_by_value(geofold)

#: A language must be at least this likely; with equal likelihoods of a few languages none is.
LIKELY = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a letter go, and those whose likeliest language is below ``LIKELY``.

    Null and empty texts have no letter.  Without any labelled document nothing can be told, and all others stay.
    """
    langs, probs = language.learn(docs, "lang", "text", "doc_id", fold(F.col("doc_id"), 3) != 1)
    names = tuple(free_name(docs, c) for c in ("_lang", "_score"))
    tagged = language.predict(docs, langs, probs, columns=names)
    if not langs:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    return tagged.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LIKELY)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 with five words and a similarity of 0.8: of each group the document with the smallest id stays.

    Of equal rows one stays; texts without words are in no group and all stay.
    """
    found = ngram_join.join(docs, width=5, percent=80)
    same, count = free_name(docs, "_same"), free_name(docs, "_count")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(same)).agg(F.count(F.lit(1)).alias(count))
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept[same]))
    # A repeated id is rare; only such rows are compared by their text.
    return rows.where(F.col(count) == 1).select(*docs.columns).unionByName(rows.where(F.col(count) > 1).select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: bytes that a document with a smaller id has are cut out; a document with nothing left goes."""
    left = suffix_dedup.spans(docs, keep_text=True).where(F.length("text") > 0)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rows repeat as often as the mix takes the document; a part of one is a row with that part's text."""
    mixed = mixing.apply_mix(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return mixed


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of token sequences of at most 4096."""
    return packing.pack_documents(docs)


STAGES = [("language", identify), ("near copies", drop_near_copies), ("repeated passages", cut_repeats), ("mix", mix), ("pack", pack)]
#: Learned models, tokens and suffix order have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
