"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. ``quality``: documents that the additive model rejects go.
2. ``near_duplicates``: of each group of SimHash near-copies one document stays.
3. ``decontamination``: documents with enough words in windows of benchmark items go.
4. ``mixing``: sources are repeated or cut to tempered shares of the tokens.
5. ``sharding``: the rest gets a shard and a place in it.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All but the last return the columns they got.
Null and empty texts, repeated rows, empty tables and further columns are handled as the docstrings of the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkaudit.llm import decontaminate, mixing, quality, sharding, simhash
from linkaudit.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the model scores one half or more. It learns from the labelled documents that are not held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), max_rows=20_000)
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of fingerprints at most 4 bits apart."""
    return simhash.keep_one_per_group(docs, shingle=4, max_bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more lies in a 13-word window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=13)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, dealt to sources by tempered shares; a document may come several times or not at all."""
    return mixing.mixed(docs, entropy_share=0.95, max_repeats=4.0)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` and ``slot``."""
    return sharding.sharded(docs, shards=16)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot express the fitted model or the hash of the fingerprints; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
