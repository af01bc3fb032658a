"""From raw documents to a training mix: five stages, each of one operator.

A stage takes (spark, docs, sf_dir) and returns what it keeps; its result is
written as Parquet and read again as the next one's docs.  All stages but the
last return the columns of ``documents``; the last adds ``taken_words`` and
``repeats``.  Near-duplicates cannot be found in SQL, so there is no ORACLE_SQL;
tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import decision_list, decontamination, mixing, simhash, toxicity
from tablewright.llm.common import shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model)


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which pass the base rules and the learned decision list."""
    rules = decision_list.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_list.keep_good(docs, rules)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of four-word shingles are
    joined by links of at most four bits, the first by its id."""
    return simhash.keep_one_of_each(docs, shingle=4, distance=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which hold no more of the benchmark than one word in twenty."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken of each."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", of_good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = shared_folder(spark, "corpus")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
