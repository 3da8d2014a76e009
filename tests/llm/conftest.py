import os

import pytest

import corpus_pipeline

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.fixture(autouse=True)
def workers_see_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    rows = [
        (1, None, None, None, 0, "x"),
        (2, "", "en", "a", 0, None),
        (3, "   \n\t ", "en", "a", 6, "x"),
        (4, "The quick brown fox isn't here. " * 4000, "en", "a", 0, "y"),
        (5, "Plain words of a short text, nothing else at all.", "en", None, 0, "y"),
        (5, "Plain words of a short text, nothing else at all.", "en", None, 0, "y"),
        (6, "Plain words of a short text, nothing else at all.", None, "b", 0, "y"),
        (7, "日本語 ünïcödé 😀 token = 'abcdef123456' ² 1st\x85", "ja", "b", 0, "y"),
        (None, "No id on this one but some words nevertheless.", "en", "b", 0, "y"),
        (8, "1234 5678 !!", "en", "c", 0, "y"),
        (9, "x" * 3000, "en", "c", 0, "y"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.createDataFrame(rows, schema)
    for c in ("shard", "size", "fp", "kept", "n_tokens", "key", "range", "y", "h", "label", "words", "epoch", "block"):
        docs = docs.withColumn(c, docs["score"])
    return docs
