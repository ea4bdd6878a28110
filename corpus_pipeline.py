"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Each stage keeps whole rows, with all their columns. Toxicity drops what scores 0.5 or more; near duplicates keeps one
row of each group of copies and near copies; decontamination drops what :func:`decontaminate.contamination` calls
contaminated; mix repeats each row as often as the mix takes it; shard adds the shard.

Null texts and empty ones are clean, are copies of each other, have no words to mix (they stay as often as their source
is taken whole) and weigh one byte in a shard. Very long texts are judged and kept whole. Rows without an id, or with
the same one, are told apart by their texts; equal rows are copies. An empty table goes through all stages empty. Extra
columns come through, whatever their names; a column ``shard`` is replaced by the last stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spinewright.core import read, shared_root
from spinewright.llm import decontaminate, mixing, sharding, simhash, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without toxic documents; trained on the labels of documents that are still there."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of copies and near copies: that with the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more of the words are benchmark passages."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated to the sources' targets."""
    return mixing.repeat(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard of each row, 0 to 15."""
    return sharding.with_shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("shard", shard),
]

#: Fingerprints, a trained classifier and k-d splits have no SQL; a test holds the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_root(spark)}/spinewright/pipeline-{uuid.uuid4().hex}/{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
