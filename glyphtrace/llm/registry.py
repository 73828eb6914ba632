"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, media, mixing, passages, quality, secrets, simhash, toxicity, winnow
from .common import fold, table


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.measured(table(spark, sf_dir, "documents"))
    return quality.score(rows, quality.train(rows, table(spark, sf_dir, "labels")))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_documents(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare(table(spark, sf_dir, "documents"))


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    spans = F.transform("offsets", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return scored.select("doc_id", "held_out", "score", "predicted", F.array_join(spans, ",").alias("toxic_spans"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op10_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(docs["doc_id"], 4) == 2
    profiles = langid.prototypes(docs.where(~held))
    return langid.predict(docs, profiles, {"doc_id": docs["doc_id"], "held_out": held})


QUERIES = {f.__name__: f for f in (op1_quality_pu, op2_secret_ownership, op3_repeated_passages, op4_media_columns, op5_byte_bpe, op6_winnowing, op7_toxic_spans, op8_source_mix, op9_simhash_dedup, op10_language_hd)}
ORACLE = {"op2_secret_ownership": secrets.ORACLE, "op8_source_mix": mixing.ORACLE}
