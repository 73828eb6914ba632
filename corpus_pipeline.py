"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, live secrets are
masked, sources are mixed to their weights, and what is left is encoded and decoded.

Cases: null texts are empty (a document without words is clean, a duplicate of others like it, and not taken by the mix);
null ids and sources are values like others; rows of equal id and text are one after the second stage; of a group the
smallest id stays; texts of any length are read whole; extra columns ride along up to the last stage; empty in, empty out.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glyphtrace.llm import bpe, secrets, stages, toxicity
from glyphtrace.llm.common import drop, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("mixing_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Stages train a model and walk linked lists, which SQL does not express; tests hold each, and the chain, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if former is not None:
            drop(former)
        former = docs
    return STAGES[-1][1](spark, docs, sf_dir)
