"""Operator 11: exact deduplication by skew-safe combining, in DataFrame functions only.

Texts are screened by digest counts: a digest that stands alone has no equal text, and
its text is not moved.  The texts of the other digests are combined in three stages,
each of which compares full contents: copies inside a task first, then the tasks'
winners by (digest, salt), where the salt spreads one text's winners over many groups,
then the winners of the salts.  A text that a third of all rows hold so reaches no
exchange with more than one row a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

SALTS = 32
# Up to so many digests (a long each to screen texts, some 60 bytes each with the winners) are broadcast.
BROADCAST_DIGESTS = 1_000_000


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def winners(docs: DataFrame, shared: DataFrame, digest: Callable[[Column], Column] = _sha256, id_col: str = "doc_id",
            text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """digest, keep_id (largest id; null if all are null), group_size of every distinct text whose
    digest is in `shared` (one column, digest)."""
    screen = shared.select(F.xxhash64("digest").alias("short")).distinct()
    few = screen.count() <= BROADCAST_DIGESTS
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col).alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text"))).withColumn("short", F.xxhash64("digest"))
    texts = texts.join(F.broadcast(screen) if few else screen, "short", "left_semi")
    # One salt for all rows of a task: the map-side part of the aggregation leaves one row
    # for each text there, which are spread over the salts.  Any salt gives the same result.
    salt = F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")
    salted = texts.select("doc_id", "text", "digest", salt).groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("text")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = _sha256,
                 salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; of equal texts the largest id stays.

    A null text counts as empty.  A null id is less than any other; a group in which all
    ids are null has a null keep_id.  Of rows repeated with the id that stays, one is
    kept.  Other columns are not read; an empty table gives no rows.  `digest` shortens
    texts; should two texts share one, the texts themselves are the digest instead.
    """
    text = _text(text_col)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), _sha256(text).alias("sha"))
    if digest is _sha256:
        narrow = narrow.drop("sha")
    narrow = stored(narrow, "digests")
    sha = F.col("digest" if digest is _sha256 else "sha")
    shared = stored(narrow.groupBy("digest").count().filter("count > 1").select("digest"), "shared-digests")
    won = stored(winners(docs, shared, digest, id_col, text_col, salts), "winners")
    if not won.groupBy("digest").count().filter("count > 1").isEmpty():
        return exact_groups(docs, id_col, text_col, digest=lambda t: t.cast("binary"), salts=salts)
    few = won.count() <= BROADCAST_DIGESTS
    # Beyond the bound the join exchanges digests; a digest with very many rows is split at run time.
    rows = narrow.join(F.broadcast(won) if few else won, "digest", "left").withColumn("sha256", F.lower(F.hex(sha)))
    top = F.col("group_size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    alone = F.col("group_size").isNull()
    rest = rows.filter(~top).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), alone.alias("kept"), F.col("sha256").alias("text_sha256"),
    )
    # Rows repeated with one id and one text are alike in every column of the result: they
    # are counted, and the first of the copies is the one that stays.
    same = rows.filter(top).groupBy("doc_id", "keep_id", "group_size", "sha256").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    tops = same.select(
        "doc_id", "keep_id", "group_size", "sha256", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")
    ).select("doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), F.col("sha256").alias("text_sha256"))
    return rest.unionByName(tops)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text no row with a larger id has.

    Of rows repeated with that id and text an arbitrary one stays."""
    ids = [F.col("doc_id").alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha")]
    grouped = exact_groups(docs, id_col, text_col).filter("group_size > 1").groupBy(*ids)
    pairs = stored(grouped.agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies")), "pairs")
    sha = F.lower(F.hex(_sha256(_text(text_col))))
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__dedup_id")) & (sha == F.col("__dedup_sha"))

    def side(part: str) -> DataFrame:
        found = pairs.filter(part).select("__dedup_id", "__dedup_sha")
        return F.broadcast(found) if found.count() <= BROADCAST_DIGESTS else found

    left = docs.join(side("NOT stays"), on, "left_anti")
    repeated = side("stays AND copies > 1")
    if repeated.isEmpty():
        return left
    one = left.join(repeated, on, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, on, "left_anti").unionByName(one)
