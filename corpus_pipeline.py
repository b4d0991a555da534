"""From raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
of `documents`. A runner may write each stage's result as Parquet and read it again for the next one; `run` does so in
the folder that the cluster shares.

For every stage: `docs` may have any further columns, whatever their names; filtering stages hand them on untouched. Null
and empty texts are clean, alike to nothing and of no words, so filtering stages keep them. Texts are taken whole,
however long. Documents are told apart by doc_id: rows that repeat one stay or go together, and rows without one can't be
named by a decision, so filtering stages keep them as they are. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from pagelake.llm.common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labels, rejects are gone.

    A score of exactly the threshold rejects. Without labels of both kinds nothing is rejected.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, so ties have no part in it.

    Texts without words are in no group.
    """
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark are gone.

    Items that are null, empty or without words have no passage; an empty benchmark takes nothing away.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; its secrets are replaced by a mark, those that overlap by one.

    A null text stays null.
    """
    return secrets.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each document's part of each block drawn.

    Documents without words or id give no row; a null source is a source. Reruns draw alike, ties included, as ids tell
    documents apart. Columns of `docs` other than doc_id, source and text aren't read.
    """
    return mixing.mixed_pieces(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
]

#: Training a machine is not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
