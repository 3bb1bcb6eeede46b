"""Queries of the text problems."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvern.llm import boilerplate, garbling, leaks, matching, tokens

#: Where the public vocabularies are; a parameter of the environment.
TOKENIZERS = os.environ.get("KVERN_TOKENIZERS", "/opt/tokenizers")


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    tables = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("subunit_pages", "job_entries", "entities"))
    return matching.match(*tables)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    sure = p1_matches(spark, folder).where(F.col("firm_confidence") >= matching.MIN_CONFIDENCE)
    return sure.select("organisasjonsnummer", "uuid")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.main_content(spark.read.parquet(f"{folder}/web_pages.parquet"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return tokens.encode_corpus(documents, f"{TOKENIZERS}/byte_bpe_50k.json")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, from their ids; empty for empty and null ones."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    encoded = tokens.encode_corpus(documents, f"{TOKENIZERS}/byte_bpe_50k.json")
    return tokens.decode_corpus(encoded, f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/eval_items.parquet")
    return leaks.find_leaks(documents, items).select("doc_id", "item_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbling.find_garbled(spark.read.parquet(f"{folder}/documents.parquet"))


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return garbling.restore_garbled(documents).select("doc_id", F.col("restored").alias("text"), "left")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p4_found": p4_found, "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_found": p8_found, "p9_found": p9_found, "p9_restored": p9_restored}
ORACLES: dict[str, str] = {"p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
MODULES = [sys.modules[__name__]]
