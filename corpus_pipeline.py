"""The corpus pipeline: stages that each take the whole of what the last one kept.

Toxic documents go, then exact copies, then near copies but one; the sources are
mixed to their weights (a document drawn twice is in the corpus twice), and the
mix is packed into training sequences. Every stage learns and counts over its own
input alone. Rows with null columns pass through as rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from loomlog.llm.common import held_out, stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the examples are those that op1 learns from."""
    labelled = table(spark, sf_dir, "labels").where(~held_out(4, 2))
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labelled))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, by a digest index of its own."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids as little-endian 32-bit numbers."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: Nearest examples, consistent sampling and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
