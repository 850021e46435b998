"""A corpus from documents to a training mix; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm import decontaminate, exact_dedup, jaccard, mixing, toxicity
from opsloom.session import scratch_path, use_utc


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled(docs.where(~toxicity.held_out()), labels))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts (five words, 0.8) one stays."""
    return jaccard.dedup(docs, jaccard.Measure(words=5, num=80, den=100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per repetition of a document, the last one cut if it is partial."""
    return mixing.materialise(mixing.mix(docs, (5.0, 2.0, 1.0), share=1.5, max_epochs=2.0))


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", copies),
    ("ngram_jaccard", near_copies),
    ("decontaminate", benchmark),
    ("mix", mixture),
]

#: Classifier scores and components are not SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; what is kept is a table in the shared folder between stages."""
    use_utc(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
