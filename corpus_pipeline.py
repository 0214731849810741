"""The corpus pipeline: documents without toxic texts, near duplicates and repeated passages, mixed to target weights, as token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.bpe import encode_corpus
from tallyloom.llm.common import shared_dir
from tallyloom.llm.jaccard import keep_one_of_each
from tallyloom.llm.mixing import mix, take_mix
from tallyloom.llm.queries import MIXTURE, domains
from tallyloom.llm.suffix import cut_repeats
from tallyloom.llm.toxicity import drop_toxic

#: Bytes of a passage that may stand but once in the corpus: some 50 words of four letters and a space.
PASSAGE = 250


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, by_text=True)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs, PASSAGE)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs, mix(docs, domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), MIXTURE, "good"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_corpus(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, block=8 << 20)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeats),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The classifiers are iterative, so SQL cannot express the rows; tests/llm holds them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, n_tokens, ids, decoded."""
    docs, place = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
