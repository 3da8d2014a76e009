"""Operator 4: shards of near equal bytes by sampled splitters, in DataFrame functions only.

Rows are ordered by a key: the text's digest, then the document's id, then a number of
the row's own, so that equal texts are neighbours and yet no two rows have one key: a
group of any number of equal rows can be divided like any other.  A sample weighted by size gives quantile boundaries of the key;
rows are partitioned into those ranges, and a range that holds too many rows is
subdivided by splitters drawn inside it.  Only per-range totals are gathered.  They
tell in which range each shard boundary falls; just there the boundary is placed
exactly.  It is moved to the edge of the group of equal texts it falls into, unless
the group is larger than a tolerated part of a shard.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored


@dataclass(frozen=True)
class ShardSettings:
    shards: int = 24
    ranges_per_shard: int = 8
    samples_per_range: int = 32
    # A range with more rows than this is subdivided.
    rows_per_range: int = 250_000
    # Groups of equal texts up to this part of a shard's share stay whole.
    whole_group: float = 0.02


DIGEST = 32


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and key: the text's digest, 17 digits in the order of the ids
    (a null id comes first), and 16 digits of the row's own.  The latter hold for a table
    written once, which the caller does before it looks at the keys."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    data = text.cast("binary")
    unsigned = F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.concat(
            F.md5(data),
            F.coalesce(F.concat(F.lit("1"), _digits(unsigned)), F.lit("0" * 17)),
            _digits(F.monotonically_increasing_id()),
        ).alias("key"),
    )


def _digits(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few values gathered before, as one literal that the JVM expands."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<" + ", ".join(f.replace(" ", ": ") for f in schema.split(", ")) + ">>")))


def _chance() -> Column:
    """A number in [0, 1) for each row, from its key alone: retried tasks draw the same sample."""
    return F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _splitters(sample: list[str], weights: list[float], pieces: int) -> list[str]:
    """Up to pieces - 1 distinct boundaries at equal steps of the sample's weight."""
    total, run, out, step = sum(weights), 0.0, [], 1
    for key, weight in sorted(zip(sample, weights)):
        run += weight
        if step < pieces and run >= total * step / pieces:
            out.append(key)
            while step < pieces and run >= total * step / pieces:
                step += 1
    return list(dict.fromkeys(out))


def _strings(values: list[str]) -> Column:
    """A literal array; keys are hexadecimal digits."""
    return F.expr("array(" + ",".join(f"'{v}'" for v in values) + ")")


def _places(points: list[str]) -> Column:
    """Number of points at or before a row's key: two steps over a sorted array."""
    if not points:
        return F.lit(0)
    block = max(1, int(len(points) ** 0.5))
    coarse = F.size(F.filter(_strings(points[::block]), lambda p: p <= F.col("key")))
    near = F.slice(_strings(points), F.greatest(coarse - 1, F.lit(0)) * block + 1, F.lit(block))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * block + F.size(F.filter(near, lambda p: p <= F.col("key"))))


def shard_by_bytes(docs: DataFrame, settings: ShardSettings = ShardSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Null texts count as empty.  Shards are in key order; slots run from 0 without gaps
    in each.  A shard's bytes differ from its share by at most a document or a group
    kept whole at each end; there may be empty shards where rows are few.  Rows repeated
    with the same id and text are one group with all rows of that text.  An empty table
    gives no rows.
    """
    n = settings.shards
    rows = stored(keyed(docs, id_col, text_col), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = n * settings.ranges_per_shard
    rate = ranges * settings.samples_per_range / total if total else 0.0
    drawn = rows.filter(_chance() < F.col("size") * rate).select("key", "size").collect()
    points = _splitters([r["key"] for r in drawn], [max(r["size"], 1 / rate) for r in drawn], ranges)
    rows = rows.withColumn("range", _places(points).cast("int")).withColumn("sub", F.lit(0))

    held = {r["range"]: r["n"] for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    overfull = {r: -(-c // settings.rows_per_range) for r, c in held.items() if c > settings.rows_per_range}
    if overfull:
        chance = F.coalesce(*[F.when(F.col("range") == r, F.lit(settings.samples_per_range * p / held[r])) for r, p in overfull.items()], F.lit(0.0))
        inner = rows.filter(_chance() < chance).select("range", "key").collect()
        sub = F.lit(0)
        for r, pieces in overfull.items():
            own = [x["key"] for x in inner if x["range"] == r]
            sub = F.when(F.col("range") == r, _places(_splitters(own, [1.0] * len(own), pieces))).otherwise(sub)
        rows = rows.withColumn("sub", sub.cast("int"))
    rows = stored(rows, "shard-ranges")

    # Totals of every range, in key order, and the shard boundaries (in bytes) inside each.
    spans = sorted(rows.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect())
    before, first_row, wanted = 0, {}, {}
    seen = 0
    for s in spans:
        first_row[(s["range"], s["sub"])] = seen
        cuts = [j for j in range(1, n) if before < total * j / n <= before + s["bytes"]]
        if cuts:
            wanted[(s["range"], s["sub"])] = (before, cuts)
        before += s["bytes"]
        seen += s["rows"]
    ends = _boundaries(rows, wanted, total, settings)

    offsets = _rows(rows.sparkSession, [(r, s, x) for (r, s), x in first_row.items()], "range int, sub int, first_row long")
    order = Window.partitionBy("range", "sub").orderBy("key")
    # One row for each range: its number is bounded by the settings and the rows' count.
    placed = rows.withColumn("nth", F.row_number().over(order)).join(F.broadcast(offsets) if len(first_row) <= 100_000 else offsets, ["range", "sub"])
    shard = sum((e.cast("int") for e in ends), F.lit(0))
    placed = placed.withColumn("shard", shard).withColumn("at", F.col("first_row") + F.col("nth") - 1)
    # First row of every shard: shards are runs of the key order.
    starts = rows.withColumn("shard", shard).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()
    held_by = {r["shard"]: r["n"] for r in starts}
    start_of, run = [], 0
    for s in range(n):
        start_of.append(run)
        run += held_by.get(s, 0)
    base = F.get(F.array(*[F.lit(x).cast("long") for x in start_of]), F.col("shard"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - base).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _boundaries(rows: DataFrame, wanted: dict, total: int, settings: ShardSettings) -> list[Column]:
    """For every shard boundary, whether a row lies beyond it."""
    if not wanted:
        return []
    n, spark = settings.shards, rows.sparkSession
    # At most one row for each shard boundary, here and in the hits below.
    aims = [(r, s, base, j, total * j / n) for (r, s), (base, js) in wanted.items() for j in js]
    aims_df = F.broadcast(_rows(spark, aims, "range int, sub int, base long, cut int, target double"))
    at = F.broadcast(_rows(spark, [(r, s, base) for (r, s), (base, _) in wanted.items()], "range int, sub int, base long"))
    order = Window.partitionBy("range", "sub").orderBy("key")
    own = rows.join(at, ["range", "sub"]).withColumn("end", F.col("base") + F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    hits = {
        h["cut"]: h
        for h in own.join(aims_df.drop("base"), ["range", "sub"])
        .filter((F.col("start") < F.col("target")) & (F.col("end") >= F.col("target")))
        .select("cut", "key", "start", "end")
        .collect()
    }
    # The groups of equal texts hit: their bytes, and those of their members before the hit.
    marks = _rows(spark, [(j, h["key"], h["key"][:DIGEST]) for j, h in hits.items()], "cut int, hit string, digest string")
    near = rows.join(F.broadcast(marks), F.substring("key", 1, DIGEST) == F.col("digest"))
    sums = {
        r["cut"]: r
        for r in near.groupBy("cut")
        .agg(F.sum("size").alias("size"), F.coalesce(F.sum(F.when(F.col("key") < F.col("hit"), F.col("size"))), F.lit(0)).alias("before"))
        .collect()
    }
    cuts = sorted(hits)
    out = []
    for j in cuts:
        target = total * j / n
        h, size = hits[j], sums[j]["size"]
        if size <= settings.whole_group * total / n:
            start = h["start"] - sums[j]["before"]
            digest = h["key"][:DIGEST]
            # A digest alone comes before all keys that begin with it, and "~" after them.
            out.append(F.col("key") >= digest if target - start <= start + size - target else F.col("key") >= digest + "~")
        else:
            out.append(F.col("key") >= h["key"] if target - h["start"] <= h["end"] - target else F.col("key") > h["key"])
    return out
