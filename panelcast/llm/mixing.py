"""Operator 1: temperature mixing of sources, in DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all sources alike)
and 1 (as they come).  The exponent is bisected until the weights reach a target
entropy, or less far if some source would then be repeated more than a limit allows.
The weights are realised without dropping a row: the source that is repeated least
plays once, the others as often as their weight asks.  The broken part of a source's
last epoch is the leading part, within its token budget, of a block permutation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored


@dataclass(frozen=True)
class MixSettings:
    # Target entropy as a part of the largest possible, ln(number of sources).
    entropy_part: float = 0.95
    max_repeats: float = 2.0
    blocks: int = 1024
    probes: int = 15
    rounds: int = 6
    # Plans of up to so many sources (a name, five numbers, two digests each) are broadcast.
    broadcast_sources: int = 50_000


def word_count(text: Column) -> Column:
    """Words between the six white-space bytes; null: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.filter(F.split(text, " "), lambda w: w != "")).cast("long")


def exponent(shares: DataFrame, settings: MixSettings) -> float:
    """Largest exponent in [0, 1] whose weights reach the target entropy, raised as far as
    the repetition limit asks.  `shares` has a column p > 0.

    Each aggregation evaluates `probes` exponents, which is log2(probes + 1) bisections."""
    n, lo_p, hi_p = shares.agg(F.count(F.lit(1)), F.min("p"), F.max("p")).first()
    if n < 2:
        return 1.0
    target = settings.entropy_part * math.log(n)

    def entropies(points: list[float]) -> list[float]:
        sums = []
        for a in points:
            w = F.pow(F.col("p"), F.lit(a))
            sums += [F.sum(w), F.sum(w * F.ln("p"))]
        row = shares.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        return [math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(points)]

    def search(enough) -> float:
        """Largest exponent that `enough` accepts; 0 is taken as accepted."""
        lo, hi = 0.0, 1.0
        if enough([1.0])[0]:
            return 1.0
        for _ in range(settings.rounds):
            points = [lo + (hi - lo) * (i + 1) / (settings.probes + 1) for i in range(settings.probes)]
            good = [p for p, ok in zip(points, enough(points)) if ok]
            lo, hi = (good[-1] if good else lo), next((p for p in points if not good or p > good[-1]), hi)
        return lo

    by_entropy = search(lambda points: [h >= target for h in entropies(points)])
    # The most repeated source plays (largest share / its share) ^ (1 - exponent) times.
    by_repeats = 1.0 - search(lambda points: [(hi_p / lo_p) ** x <= settings.max_repeats for x in points])
    return max(by_entropy, by_repeats)


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def _block(epoch: Column, doc_id: Column, blocks: int) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(_digest(epoch.cast("string"), name), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")


def mixing_plan(rows: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """One row per source of `rows` (doc_id, source, n_tokens): tokens, weight, repeats and
    where its broken last epoch ends (cut_block, cut_doc in the permuted order; null: nowhere)."""
    tokens = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "source-tokens")
    total, most = tokens.agg(F.sum("tokens"), F.max("tokens")).first()
    if not total:
        return tokens.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("exponent"), F.lit(1.0).alias("repeats"),
                             F.lit(None).cast("string").alias("cut_block"), F.lit(None).cast("string").alias("cut_doc"))
    shares = tokens.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(total)))
    a = exponent(shares.select("p"), settings)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    scale = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    repeats = F.when(F.col("tokens") > 0, F.round(F.pow(F.lit(float(most)) / F.col("tokens"), F.lit(1.0 - a)), 6)).otherwise(1.0)
    plan = tokens.select("source", "tokens", (power / scale).alias("weight"), F.lit(a).alias("exponent"), repeats.alias("repeats"))
    plan = plan.withColumn("full", F.floor("repeats").cast("int")).withColumn(
        "budget", F.floor((F.col("repeats") - F.floor("repeats")) * F.col("tokens")).cast("long")
    )
    small = plan.filter("budget > 0").select("source", "full", "budget")
    # The last epoch's order: blocks by their digest, documents in a block by theirs.
    last = _joined(rows, small, settings).select("source", "budget", "n_tokens", *_order(F.col("full"), F.col("doc_id"), settings))
    blocks = last.groupBy("source", "budget", "block_order").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy("source").orderBy("block_order")  # `blocks` rows for a source at most
    blocks = stored(blocks.withColumn("end", F.sum("tokens").over(run)).withColumn("start", F.col("end") - F.col("tokens")), "mix-blocks")
    # The block in which the budget ends: only its documents are ordered one by one.
    edge = blocks.filter((F.col("start") <= F.col("budget")) & (F.col("end") > F.col("budget"))).groupBy("source").agg(
        F.min_by("block_order", "start").alias("cut_block"), F.min("start").alias("start")
    )
    edge = stored(edge, "mix-edge")
    inside = last.alias("l").join(
        F.broadcast(edge.alias("e")) if edge.count() <= settings.broadcast_sources else edge.alias("e"),
        F.col("l.source").eqNullSafe(F.col("e.source")) & (F.col("l.block_order") == F.col("e.cut_block")),
    )
    inner = Window.partitionBy("l.source").orderBy("doc_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over = inside.select(F.col("l.source").alias("source"), "doc_order", (F.col("start") + F.sum("n_tokens").over(inner) > F.col("budget")).alias("over"))
    cut = over.filter("over").groupBy("source").agg(F.min("doc_order").alias("cut_doc"))
    cuts = edge.alias("e").join(cut.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left").select("e.source", "cut_block", "cut_doc")
    out = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return stored(out.select("p.source", "p.tokens", "p.weight", "p.exponent", "p.repeats", "c.cut_block", "c.cut_doc"), "mix-plan")


def _order(epoch: Column, doc_id: Column, settings: MixSettings) -> list[Column]:
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    block = _block(epoch, doc_id, settings.blocks)
    return [
        _digest(epoch.cast("string"), F.lit("block"), block.cast("string")).alias("block_order"),
        _digest(F.lit("doc"), epoch.cast("string"), name).alias("doc_order"),
    ]


def _joined(rows: DataFrame, plan: DataFrame, settings: MixSettings) -> DataFrame:
    """rows with the columns of `plan`, one row per source: broadcast while sources are few."""
    plan = plan.withColumnRenamed("source", "__mix_source")
    few = plan.count() <= settings.broadcast_sources
    return rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of `docs` once for each epoch it plays in, with the struct __mix: n_tokens,
    epoch (from 0), block, block_order, doc_order, weight, repeats, exponent.

    Every row plays at least once.  A null source is a source; a source without a token
    plays once.  Rows that share an id and a source play the same epochs.  Tokens are
    words between white space.  Columns keep their names; "__mix" ones are reserved.
    """
    rows = docs.withColumn("__mix_words", word_count(F.col(text_col)))
    narrow = stored(rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col("__mix_words").alias("n_tokens")), "mix-tokens")
    plan = mixing_plan(narrow, settings)
    plan = plan.select([F.col(c).alias(f"__mix_{c}") for c in plan.columns])
    few = plan.count() <= settings.broadcast_sources
    rows = rows.join(F.broadcast(plan) if few else plan, F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source")), "left")
    full = F.floor("__mix_repeats").cast("int")
    block_order, doc_order = _order(full, F.col(id_col), settings)
    partly = (F.col("__mix_repeats") > full) & (
        (block_order < F.col("__mix_cut_block"))
        | ((block_order == F.col("__mix_cut_block")) & F.coalesce(doc_order < F.col("__mix_cut_doc"), F.lit(True)))
    )
    epochs = full + F.coalesce(partly, F.lit(False)).cast("int")
    rows = rows.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    own_block, own_doc = _order(F.col("__mix_epoch"), F.col(id_col), settings)
    info = F.struct(
        F.col("__mix_words").alias("n_tokens"),
        F.col("__mix_epoch").alias("epoch"),
        _block(F.col("__mix_epoch"), F.col(id_col), settings.blocks).alias("block"),
        own_block,
        own_doc,
        F.col("__mix_weight").alias("weight"),
        F.col("__mix_repeats").alias("repeats"),
        F.col("__mix_exponent").alias("exponent"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], info.alias("__mix"))
