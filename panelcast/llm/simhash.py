"""Operator 7: SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within three bits of each other are linked.  Half of three is not whole,
and balls of radius two (2,081 variants of each fingerprint) would be needed on all 64
bits.  So one of three blocks of bits is left out first: of three or fewer differing
bits, at least one lies in some block (or none differs), hence without that block at
most two differ, and each side meets the other at one flip.  A fingerprint therefore
emits, for each of the three blocks left out, its remaining bits and those with any
single bit flipped: 131 variants.  Fingerprints that share a variant are compared on
all 64 bits.  Copies share a fingerprint and are one row from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .components import connected_components
from .store import stored

BITS = 64
SEED = 42
# Three blocks of bits, [from, to).
BLOCKS = ((0, 22), (22, 43), (43, 64))
HASHES_AT_ONCE = 1 << 17
# Up to so many longs (16 MB) are broadcast; beyond, both sides are exchanged.
BROADCAST_VARIANTS = 2_000_000
# Up to so many pairs of an id and a digest (40 bytes each) are broadcast.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Unsigned fingerprint of a UTF-8 text: bit set where over half of the shingles' hashes have it.

    Words are separated by the six ASCII white-space bytes, A-Z are lower-cased; a text
    of fewer words than a shingle is one shingle; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    stops = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[i:j], SEED) for i, j in zip(starts, stops)], np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, HASHES_AT_ONCE):
        part = hashes[k : k + HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, fp) of every row, and on request the SHA-256 of its text; fp holds the 64 bits as a
    signed long.  Null text: no word."""

    def task():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", shingle_words) for t in texts), np.uint64, len(texts))
            more = [batch.column(2)] if digest else []
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *more], names=["doc_id", "fp", *["digest"] * digest])

        return step

    extra = [text_digest(text_col).alias("digest")] if digest else []
    return map_texts(docs, task, "doc_id long, fp long" + ", digest binary" * digest, id_col, text_col, extra)


def text_digest(text_col: str) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def _mask(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _variants() -> list[tuple[int, int, int]]:
    """(bits kept, bit flipped or 0, block left out) of every variant."""
    full = (1 << BITS) - 1
    out = []
    for k, (lo, hi) in enumerate(BLOCKS):
        keep = full ^ _mask(lo, hi)
        out.append((keep, 0, k))
        out += [(keep, 1 << i, k) for i in range(BITS) if not lo <= i < hi]
    return out


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)) for v in values])


def near_links(distinct_fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a < b) whose components are those of all pairs of distinct fps within `max_bits` (3).

    Fingerprints that meet in a variant and agree on the left-out block differ in at
    most two bits, so each is linked to the least of them only.  Those that differ there
    are linked over one member of each such set, chosen so that every true link's
    ends stay connected; every link is verified on all bits.
    """
    if max_bits != 3:
        raise ValueError("the three left-out blocks are laid out for a distance of 3 bits")
    variants = _variants()
    block_of = F.array(*[F.lit(k).cast("byte") for _, _, k in variants])
    rows = distinct_fps.select("fp", F.posexplode(_longs([k for k, _, _ in variants])).alias("j", "keep")).select(
        "fp",
        F.col("fp").bitwiseAND(F.col("keep")).bitwiseXOR(F.element_at(_longs([f for _, f, _ in variants]), F.col("j") + 1)).alias("variant"),
        F.element_at(block_of, F.col("j") + 1).alias("block"),
    )
    at = ["variant", "block"]
    # One exchange on the variant serves the counts and, for shared variants, the sets.
    met = rows.repartition(*at).groupBy(*at).agg(
        F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    met = stored(met, "met")
    within = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    pairs = met.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).filter(within("a", "b"))

    # Few variants are crowded: counted, and sent to the rows rather than all rows to them.
    crowded = met.filter("n > 2").select(*at)
    if crowded.count() <= BROADCAST_VARIANTS:
        crowded = F.broadcast(crowded)
    members = stored(rows.join(crowded, at), "members")
    left_out = F.element_at(_longs([_mask(lo, hi) for lo, hi in BLOCKS]), F.col("block") + 1)
    members = members.withColumn("m", F.col("fp").bitwiseAND(left_out))
    # The centre of a set is the fingerprint whose kept bits are the variant itself.
    centre = F.col("variant").bitwiseOR(F.col("m"))
    sets = members.groupBy(*at, "m").agg(
        F.min("fp").alias("rep"), F.max(F.when(F.col("fp") == centre, F.col("fp"))).alias("centre")
    )
    star = members.join(sets.select(*at, "m", "rep"), [*at, "m"]).select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    across = _across(stored(sets, "sets"))
    many = star.unionByName(across).filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    many = many.filter(within("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(many).distinct()


# Sets of one variant up to which all are compared with each other.
FEW_SETS = 64


def _across(sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets of one variant whose left-out bits differ in one to three places.

    Where a variant has many sets they meet in the middle once more: each sends its
    left-out bits with up to one bit flipped, and with up to two, so that only sets
    within three bits of each other come together."""
    at = ["variant", "block"]
    counts = stored(sets.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "set-counts")
    side = lambda n: sets.select(*at, F.col("m").alias(f"m{n}"), F.col("rep").alias(f"r{n}"), F.col("centre").alias(f"c{n}"))
    few = counts.filter(F.col("n") <= FEW_SETS).select(*at)
    near = side(1).join(few, at).join(side(2), at)
    crowded = counts.filter(F.col("n") > FEW_SETS).select(*at)
    if not crowded.isEmpty():
        ones = [[0, *(1 << i for i in range(lo, hi))] for lo, hi in BLOCKS]
        twos = [sorted({x ^ y for x in own for y in own}) for own in ones]

        def balls(n: int, flips: list[list[int]]) -> DataFrame:
            flip = F.element_at(F.array(*[_longs(f) for f in flips]), F.col("block") + 1)
            return side(n).join(crowded, at).withColumn("flip", F.explode(flip)).withColumn("meet", F.col(f"m{n}").bitwiseXOR(F.col("flip"))).drop("flip")

        met = balls(1, ones).join(balls(2, twos), [*at, "meet"]).drop("meet")
        near = near.unionByName(met.select(near.columns))
    apart = F.bit_count(F.col("m1").bitwiseXOR(F.col("m2")))
    # One bit apart: any member of one set with any of the other.  Two: a centre with any
    # member.  Three: the two centres.  (Both orders of a pair of sets occur.)
    return near.filter((F.col("m1") != F.col("m2")) & (apart <= 3)).select(
        F.when(apart == 1, F.col("r1")).otherwise(F.col("c1")).alias("a"),
        F.when(apart == 3, F.col("c2")).otherwise(F.col("r2")).alias("b"),
    )


def components_of(fps: DataFrame, max_bits: int) -> DataFrame:
    """fp, label (smallest linked fp), component_id (smallest linked id) of every distinct fp of (doc_id, fp)."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = connected_components(near_links(distinct.select("fp"), max_bits))
    linked = labels.join(distinct, labels["node"] == distinct["fp"]).select("node", "label", "least")
    roots = linked.groupBy("label").agg(F.min("least").alias("root"))
    moved = linked.join(roots, "label").select(F.col("node").alias("fp"), "label", "root")
    return stored(
        distinct.join(moved, "fp", "left").select(
            "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("root", "least").alias("component_id")
        ),
        "components",
    )


def near_duplicate_components(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3,
                              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable) of every row.

    Texts without a word, null ones included, share fingerprint zero and are linked.
    Repeated rows give repeated results; a null id takes part in links but is never a
    component's id unless no other is there.  An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    # One row per fingerprint against all documents: both sides are exchanged by the
    # join alone, so that a fingerprint with very many copies can be split at run time.
    table = components_of(fps, max_bits).drop("label")
    return fps.join(table, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with one row of each near-duplicate component.

    It is the one with the smallest id (of those, the text with the least digest); a row
    without an id stays only where its component has no other.  Rows are told apart by id
    and text, so one id on two texts loses neither component; of rows repeated with the
    same id and text an arbitrary one stays."""
    fps = stored(fingerprints(docs, shingle_words, id_col, text_col, digest=True), "fingerprints")
    table = components_of(fps, max_bits).drop("component_id")
    rows = fps.groupBy("doc_id", "digest", "fp").agg(F.count(F.lit(1)).alias("copies"))
    rows = stored(rows.join(table, "fp", "left").withColumn("nameless", F.col("doc_id").isNull()), "dedup-rows")
    first = stored(rows.groupBy("label").agg(F.min(F.struct("nameless", "doc_id", "digest")).alias("first")), "dedup-first")
    judged = rows.join(first, "label").select(
        F.col("doc_id").alias("__dedup_id"), F.col("digest").alias("__dedup_digest"), "copies",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("stays"),
    )
    judged = stored(judged.filter("NOT stays OR copies > 1"), "dedup-judged")
    on = F.col(id_col).cast("long").eqNullSafe(F.col("__dedup_id")) & (text_digest(text_col) == F.col("__dedup_digest"))

    def side(part: str) -> DataFrame:
        found = judged.filter(part).select("__dedup_id", "__dedup_digest")
        # Counted: few are sent to the texts; beyond that, both sides are exchanged.
        return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found

    left = docs.join(side("NOT stays"), on, "left_anti")
    repeated = side("stays")
    if repeated.isEmpty():
        return left
    one = left.join(repeated, on, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(repeated, on, "left_anti").unionByName(one)
