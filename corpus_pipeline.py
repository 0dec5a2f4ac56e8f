"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, written as Parquet and reread. A stage decides on all of it
and its decision takes effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill import scratch
from grainmill.llm import langid, mixing, packing, quality_rules, simhash_similar
from grainmill.llm.queries import tokenizer_path
from grainmill.session import reach_workers


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' cascade keeps; short ones are not rejected for that alone."""
    return quality_rules.Cascade.fit(docs, quality_rules.FILTER).apply(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language."""
    reach_workers(spark)
    return langid.keep_known(docs, langid.train(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: four fifths of their five-word shingles in common."""
    reach_workers(spark)
    return simhash_similar.deduplicate(docs).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, a row for each epoch in which one is taken."""
    return mixing.apply(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its place there."""
    reach_workers(spark)
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), 0))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The stages' models and fingerprints have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
