"""A training corpus from raw documents: five stages, each one of the operators in ``riskweft.llm``.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last
returns the encoded corpus.  ``run`` writes each stage's rows to the shared folder and reads them again.

Nulls: a null text has no letter and is rejected by the first stage.  Null ids are kept row by row.  Repeated
rows are near duplicates of each other.  Empty tables pass through every stage.  Columns of documents that are named
like one of an operator's come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskweft.llm import bpe, decontaminate, langid, neardup, toxicity
from riskweft.llm.queries import TOXIC_FROM, vocabulary_path
from riskweft.llm.store import bound_batches, read, stored

#: Least share of a text's n-grams that its language must know.
KNOWN_SHARE = 0.1


#: Columns that the stages read; every other one is only carried.
READ = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """``stage`` on documents whose other columns bear neutral names meanwhile."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        names = {c: c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.withColumnsRenamed(names), sf_dir)
        return out.withColumnsRenamed({n: c for c, n in names.items() if n in out.columns})

    return run


@carrying
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that no learnt language fits."""
    judged = langid.identify(docs, langid.fit_filters(docs))
    fits = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= KNOWN_SHARE)
    return judged.filter(fits).select(docs.columns)


@carrying
def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose toxicity reaches the threshold; learnt from the labels of documents still here."""
    learn = toxicity.labelled(docs, read(spark, sf_dir, "labels"), "toxic")
    judged = toxicity.score_toxicity(docs, toxicity.fit_toxicity(learn))
    return judged.filter(F.col("toxicity") < TOXIC_FROM).select(docs.columns)


@carrying
def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the smallest id (null last), one row of it.

    Texts group at a Jaccard similarity of 0.8 or more of their five-word shingles, asked of texts that meet by
    SimHash fingerprints within 3 bits, or else by min-hashes.
    """
    groups = neardup.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "shingle_set")).alias("first")
    kept = groups.groupBy("component").agg(first).select("first.doc_id", "first.shingle_set")
    key = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__unknown")]
    kept = stored(kept.select(*key, F.col("shingle_set").alias("__set")), "kept")
    rows = neardup.with_set(docs).withColumnRenamed("shingle_set", "__set")
    rows = rows.select("*", *key).join(kept, ["__id", "__unknown", "__set"], "left_semi")
    return rows.dropDuplicates(["__id", "__unknown", "__set"]).select(docs.columns)


@carrying
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that contain a benchmark item."""
    flagged = decontaminate.flag_contaminated(docs, read(spark, sf_dir, "benchmark"))
    return flagged.filter(F.size("benchmark_items") == 0).select(docs.columns)


@carrying
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of their decoding."""
    made = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return made.select(
        "doc_id", "lang", "source", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids").alias("ids"),
        F.col("bpe_ids_sha256").alias("ids_sha256"), F.col("bpe_decoded_sha256").alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("bpe_encoding", encode_tokens),
]

#: Learnt models, hash fingerprints and merges are not SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
