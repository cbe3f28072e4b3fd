"""From raw documents to packed sequences: five stages, each one operator of ``rillflow.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again before the next.  All but the last return the columns
of ``documents``, whatever more there are.

Defined cases, alike for all stages: an empty table gives an empty one; rows
with null, empty or blank texts pass the filters, as they have neither
insults, shingles, windows nor 100 bytes, and are packed as one token; rows
with null ids pass the filters unless toxic or contaminated; of repeated rows
near-dedup leaves one, and where ids repeat with other texts each row is judged
by its own text; very long texts are read whole; a caller's columns with names
that stages use inside are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import cut, free_name, table
from rillflow.llm.decontaminate import drop_contaminated
from rillflow.llm.near_dup import drop_near_duplicates
from rillflow.llm.packing import pack
from rillflow.llm.suffix_dedup import remove_repeats
from rillflow.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, k=5, percent=80)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that start earlier go; every document stays, ``n_chars``, where there is one, follows its text."""
    count = free_name(docs.columns, "n_removed")
    done = remove_repeats(docs, count=count)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
