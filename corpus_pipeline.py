"""The training-data pipeline: stages over ``documents``, each written and read again by the next.

    run(spark, sf_dir)   all stages over the table ``documents`` of a folder

Every stage works on the rows that the one before has kept, and all but the
last return the columns of ``documents``:

* ``language_id`` drops texts without a language (null, without a letter, or
  in which no language has half of the network's probability, or so much less
  as one in a thousand of all labelled documents lacks too); in a table without
  labels only nulls and texts without a letter;
* ``near_dedup`` keeps one document of each group of near copies (five-word
  shingles, similarity 0.8);
* ``decontaminate`` drops documents that hold a passage of ``benchmark``;
* ``mix_sources`` brings the sources to their target weights, repeating a row
  for every epoch that takes it;
* ``shard`` says where each row goes.

Tables and columns that a stage needs must be there; nulls, empty and very
long texts, repeated rows, empty tables and extra columns have the results
that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from innings.llm import decontamination, langid, minhash, mixing, sharding
from innings.llm.tables import stored, table
from innings.session import bounded_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
    ("mix_sources", mix_sources), ("shard", shard),
]

#: Trained models and alignment take part: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
