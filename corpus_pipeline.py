"""A corpus from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: quality rules, then a
quality classifier, near-duplicates, mixing by source, and BPE. All but the last
return the columns of documents. ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscope.llm.bpe import bpe_encode
from linkscope.llm.common import cut
from linkscope.llm.convnet import quality_keep
from linkscope.llm.mixing import mix_rows
from linkscope.llm.neardup import drop_near_duplicates
from linkscope.llm.rules import quality_filter


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep; those of base faults go."""
    return quality_filter(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores as good; it learns from labels alone."""
    return quality_keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; a document taken twice has two rows."""
    return mix_rows(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts."""
    return bpe_encode(docs, "byte_bpe_50k.json").drop("text").withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", tokens_stage),
]

#: Expectation-maximisation, a trained network and BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
