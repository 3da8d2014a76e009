"""Registered queries of this package: thin wrappers over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, exact_dedup, langid, mixing, quality, secrets, sharding, simhash, token_counts, topk, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def op1_temperature_mixing(spark, sf_dir):
    """Every document once for each epoch its source's mixing weight asks for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "source", "__mix.*")


def op2_toxicity(spark, sf_dir):
    """Toxicity score of every whole document; labels are learned outside the held-out quarter."""
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    held = remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, labels, ~held)
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_byte_bpe(spark, sf_dir):
    """Byte-level BPE of every whole document: ids, decoded again, as digests."""
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    """Token counts of every whole document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_secrets(spark, sf_dir):
    """Secrets of every whole document: the rules' spans and the network's."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs)).drop("redacted")


def op7_simhash(spark, sf_dir):
    """SimHash near-duplicate components: three-word shingles, three bits."""
    return simhash.near_duplicate_components(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op8_language_id(spark, sf_dir):
    """Language of every whole document; learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 5) == 0
    return langid.predict(docs, langid.fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_quality(spark, sf_dir):
    """Quality rules and verdict of every whole document."""
    rows = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return quality.verdicts(rows, quality.language_references(rows)).select("doc_id", "__quality.*")


def op10_top_k(spark, sf_dir):
    """The 20 best candidates by integer inner product of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op11_exact_dedup(spark, sf_dir):
    """Groups of equal texts over all documents; the largest id of each stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    """The eight leading whitened components of every vector."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, offset=100_000)
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_token_alignment(spark, sf_dir):
    """Alignment of two tokenizers on every whole document, with corpus-wide pair counts."""
    a, b = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.alignment(table(spark, sf_dir, "documents"), a, b)


def queries() -> dict:
    found = (
        op1_temperature_mixing, op2_toxicity, op3_byte_bpe, op4_sharding, op5_token_counts,
        op6_secrets, op7_simhash, op8_language_id, op9_quality, op10_top_k,
        op11_exact_dedup, op12_whitening, op13_token_alignment,
    )
    return {f.__name__: f for f in found}


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), g AS (
  SELECT doc_id, text, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
         row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS nth
  FROM d WINDOW same AS (PARTITION BY text)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(text) AS text_sha256 FROM g
"""


def oracle_sql() -> dict:
    return {"op10_top_k": OP10_SQL, "op11_exact_dedup": OP11_SQL}
