"""A corpus pipeline in five stages: documents in, shards of a clean mixture out.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the docs of the next. All but the last return the columns of
``documents``; the last adds shard and slot. A stage that fails can be run again from the table before it.

In every stage a row is decided as a row: null or repeated ids neither merge rows nor drop others, further columns travel along whatever
their names are, texts are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontamination, language, minhash, mixing, sharding
from strandlake.llm.scratch import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts like none of the languages learned from the labelled rows.

    Null and empty texts have no letters. Rows without a label are judged like others; without any label in the table all rows go. Equal texts are
    decided alike.
    """
    return language.accepted(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more; 48 bands of 6 miss a pair at 0.8 with a chance of 5e-7.

    The row with the smallest id stays; a null id comes last, and of equal ids one row stays. Rows whose text is null or has no words are in
    no group and stay.
    """
    return minhash.deduplicated(docs, percent=80, n_bands=48)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain at least 0.8 of the shingles of a benchmark item.

    Null and blank texts contain nothing and stay; items without words or with a null text match nothing; repeated rows go or stay together.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that each source's words come to its target.

    Rows without a source are a source of their own; rows without words stay once. Of rows equal in everything the right number is taken.
    """
    return mixing.repeated(mixing.mix(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows into 24 shards, each with the mixture of the whole.

    Rows without a source are a stratum of their own; repeated rows, such as the mix makes, each get a slot.
    """
    return sharding.shard(docs, 24)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]

#: SQL cannot express the trained classifier; tests check each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
