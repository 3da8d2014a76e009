"""The training-data pipeline over `documents`, one operator a stage.

Every stage reads what its predecessor kept, written as Parquet.  Part of the
training-data package: it is of no use without `panelcast.llm`.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import byte_bpe, mixing, quality, secrets, simhash
from panelcast.llm.store import working_tables
from panelcast.session import delete_folder, write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the count rules and are near some language's histograms."""
    return quality.passing(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    return simhash.deduplicated(docs, shingle_words=3, max_bits=3)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found secret replaced in the text."""
    return secrets.redact_documents(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and again for each epoch its source's weight asks for."""
    return mixing.mix(docs).drop("__mix")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digest of the bytes they decode to."""
    rows = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return rows.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "n_bytes", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

# The network of the secrets stage and the tokenizer's merges are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  A stage's working tables and its predecessor's result are deleted once
    its own result is written, so at most two copies of the texts exist at a time."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with working_tables(spark):
            path = write_table(stage(spark, docs, sf_dir), f"llm-{name}")
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
