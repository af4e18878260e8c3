"""From documents to the shards of the selected ones in five stages, each a stored table that the next one reads.

Each stage reads all rows of the one before and, but for the last, returns the columns of documents as they were, foreign
ones included; the last returns each row's place, not its text. Nulls, empty texts, repeated rows and empty tables pass
through as each operator's docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.llm.decontaminate import without_items
from patronage.llm.linking import free_names
from patronage.llm.mixing import repeat_documents
from patronage.llm.ngram_join import Similarity, keep_one_per_component
from patronage.llm.quality import grade_documents
from patronage.llm.sharding import shard_rows
from patronage.session import ensure_checkpoint_dir


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels of the folder, finds good; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = free_names(docs, "expected_grade", "tail", "selected")
    return grade_documents(docs, labels, names=names).where(F.col(names[-1])).select(*[f"`{c}`" for c in docs.columns])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    return keep_one_per_component(docs, Similarity(size=5, num=80, den=100))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that the mix has taken."""
    return shard_rows(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier's weights come from an iterative fit, which SQL cannot express; tests check the stages by brute force.
ORACLE_SQL = None
