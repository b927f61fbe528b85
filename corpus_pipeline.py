"""A training corpus from raw documents, in five stages.

Documents of low quality go; one of each group of near copies stays; passages of the benchmark
go, with the documents that they mostly make up; sources are mixed to their weights, which
repeats or leaves out documents; and the rest is stored as token ids, checked by reading back.

Documents without doc_id stay through all stages. Rows that repeat a doc_id with one text become one in
the second stage. Null and empty texts are scored, linked with nothing, and stored as their end id, unless
a stage's rule drops them. Columns of any names go through up to the last stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidloom.llm.decontaminate import decontaminated
from evidloom.llm.mixing import mixed
from evidloom.llm.ngram_join import one_of_each_group
from evidloom.llm.quality import good_documents
from evidloom.llm.queries import tokenizer_path
from evidloom.llm.scratch import remove, written
from evidloom.llm.token_store import token_store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the store, repeats of a document included."""
    return token_store(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_each_group),
    ("decontaminate", remove_benchmark),
    ("mix", mix_sources),
    ("token_store", store_tokens),
]

#: The quality stage is learnt, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            remove(spark, last)
        last = path
    return docs
