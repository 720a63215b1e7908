"""A corpus pipeline of five stages, each written as Parquet before the next.

Toxic documents go, then exact copies, then near copies; sources are mixed to
their target weights, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkarray.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from sparkarray.llm._common import Scope, drop_stored, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model learns from the labelled ones among ``docs``."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the least id stays."""
    return near_dedup.keep(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in token sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("best_fit_packing", pack_sequences)]

#: SQL cannot express the first and the last stage; the tests compare ``run`` with a plain version of all five.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; a stage's tables go when the next one is stored."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with Scope() as scope:
            found = scope.keep(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        if name != STAGES[0][0]:
            drop_stored(docs)
        docs = found
    return docs
