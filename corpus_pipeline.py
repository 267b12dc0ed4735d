"""Training-data pipeline: five stages over ``documents``, each one a table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's
rows as Parquet in the shared checkpoint folder and hands the next one what was
written. The first four return the columns of ``documents``; the last one returns the pieces
of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfrank.llm import decontaminate, packing, simhash, suffix_dedup, toxicity
from shelfrank.llm.common import prepare, stash, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity score reaches 0.5."""
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of linked fingerprints."""
    prepare(spark)
    return simhash.keep_one(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every 200-byte string that starts more than once out of the texts."""
    prepare(spark)
    return suffix_dedup.strip(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that leak a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of what is left into sequences."""
    prepare(spark)
    return packing.pack(docs, packing.tokenizer_paths())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_dedup", strip_repeats),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("packing", pack_sequences),
]

# Models, components and token ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
