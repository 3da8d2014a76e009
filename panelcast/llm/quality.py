"""Operator 9: quality rules by distribution divergence, in DataFrame functions only.

Two rules on counts come first (too few words; too many words in repeated windows).
Then a document's histograms of character classes, of common short words and of all
its words are compared with those of every language in the corpus, by Jensen-Shannon
divergence in bits (0 equal, 1 disjoint).  A document far from all languages is
rejected, unless it is too short for its histogram to say much.  The histogram of all
words has the common words, the other short ones and the long ones: a text of enough
words that lacks the short ones is far, too.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

# The six white-space bytes that separate words, and the symbols counted.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    max_repeat_percent: int = 30
    window_words: int = 8
    # Words of up to this many characters are counted; the commonest of each language form its histogram.
    short_letters: int = 4
    common_words: int = 20
    # Guards: below these sizes a histogram is not compared.
    min_chars: int = 200
    min_short_words: int = 20
    max_class_divergence: float = 0.12
    max_word_divergence: float = 0.45
    # The comparison of all words, from min_all_words on; None leaves it out of the verdict.
    min_all_words: int = 40
    max_all_divergence: float | None = None


# All rules: what the functions below, the query and the pipeline judge by.
ALL_RULES = QualityRules(max_all_divergence=0.15)

RESERVED = "__q_"


def _c(name: str) -> Column:
    return F.col(RESERVED + name)


def _with(df: DataFrame, **cols: Column) -> DataFrame:
    return df.withColumns({RESERVED + k: v for k, v in cols.items()})


def _counted(docs: DataFrame, text_col: str, rules: QualityRules) -> DataFrame:
    """Words, short words and character classes.

    Every white-space byte is one separator of the raw split, so it also counts them.
    One replacement takes lower-case letters and white space away; the other classes are
    counted on what little is left."""
    df = _with(docs, text=F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    spaced = _c("text")
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    df = _with(df, raw=F.split(spaced, " "), rest=F.regexp_replace(_c("text"), r"[\p{Ll}\x20\x09-\x0D]+", ""))
    left = F.char_length(_c("rest")).cast("long")
    gone = lambda pattern: left - F.char_length(F.regexp_replace(_c("rest"), pattern, ""))
    df = _with(
        df,
        words=F.filter(_c("raw"), lambda w: w != ""),
        n_text=F.char_length(_c("text")).cast("long"),
        space=(F.size(_c("raw")) - 1).cast("long"),
        rest_n=left,
        symbol=gone(SYMBOLS),
        upper=gone(r"\p{Lu}+"),
        digit=gone(r"\p{N}+"),
    ).drop(RESERVED + "raw", RESERVED + "rest")
    return _with(
        df,
        lower=_c("n_text") - _c("space") - _c("rest_n"),
        other=_c("rest_n") - _c("symbol") - _c("upper") - _c("digit"),
        short=F.filter(_c("words"), lambda w: F.char_length(w) <= rules.short_letters),
    )


def measured(docs: DataFrame, rules: QualityRules = ALL_RULES, text_col: str = "text",
             keep_text: bool = True) -> DataFrame:
    """`docs` with the counts of every text, written once: references and verdicts both read it.

    Null and empty texts have no words.  All columns stay; names that begin with
    "__q_" are reserved.  keep_text=False leaves the text column out of what is written."""
    w = rules.window_words
    df = _counted(docs, text_col, rules)
    lines = F.filter(F.split(_c("text"), "\n"), lambda s: F.trim(s, F.lit(" \t\x0b\x0c\r")) != "")
    df = _with(df, n_words=F.size(_c("words")).cast("long"), lines=lines, h=F.transform(_c("words"), lambda x: F.xxhash64(x)))
    df = _with(df, n_dup=(F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long")).drop(
        *(RESERVED + k for k in ("lines", "words", "text"))
    )
    # Windows of 2, 4, 8 words: a hash of the hashes of two windows that make it up.
    width = 1
    while width < w:
        step = min(width, w - width)
        fewer = F.greatest(F.size(_c("h")) - step, F.lit(0))
        df = _with(df, h=F.zip_with(F.slice(_c("h"), F.lit(1), fewer), F.slice(_c("h"), F.lit(1 + step), fewer), lambda x, y: F.xxhash64(x, y)))
        width += step
    df = _with(df, again=F.size(F.array_distinct(_c("h"))) < F.size(_c("h")))
    order = F.when(_c("again"), F.sort_array(F.transform(_c("h"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = _with(df, order=order).drop(RESERVED + "h")
    same = lambda i, j: F.get(_c("order"), i)["h"] == F.get(_c("order"), j)["h"]
    twice = F.filter(_c("order"), lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    df = _with(df, at=F.when(_c("again"), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop(RESERVED + "order")
    reach = F.zip_with(_c("at"), F.slice(_c("at"), F.lit(2), F.size(_c("at"))), lambda x, y: F.least(F.coalesce(y - x, F.lit(w)), F.lit(w)))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda s, x: s + x)
    df = _with(df, n_repeat=F.when(_c("again"), covered).otherwise(F.lit(0).cast("long"))).drop(RESERVED + "at", RESERVED + "again")
    return stored(df if keep_text else df.drop(text_col), "measured")


def language_references(rows: DataFrame, rules: QualityRules = ALL_RULES, lang_col: str = "lang") -> dict:
    """Histograms of every language over all its documents in `measured` rows.

    {"words": [...], "classes": {lang: [...]}, "short": {lang: [...]}, "all": {lang: [...]}}:
    all but the first hold probabilities, the last of "short" being that of all other short
    words; "all" has the same words as shares of all words, and last that of the long ones.
    What reaches the driver is 7 + common_words + 1 numbers for each language.
    """
    rows = rows.filter(F.col(lang_col).isNotNull()).withColumn("__q_lang", F.col(lang_col).cast("string"))
    classes = rows.groupBy("__q_lang").agg(*[F.sum(_c(k)).alias(k) for k in (*CLASSES, "n_words")]).collect()
    words = rows.select("__q_lang", F.explode(_c("short")).alias("value"))
    counts = stored(words.groupBy(F.col("__q_lang").alias("lang"), "value").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # Each language's commonest words: the best of many groups first, then those few together.
    best_of = lambda c: F.slice(F.sort_array(F.collect_list(c)), 1, rules.common_words).alias("best")
    top = (
        counts.groupBy("lang", F.pmod(F.xxhash64("value"), F.lit(64)).alias("part"))
        .agg(best_of(F.struct((-F.col("n")).alias("m"), F.col("value"))))
        .select("lang", F.explode("best").alias("b"))
        .groupBy("lang")
        .agg(best_of(F.col("b")))
    )
    vocabulary = sorted({b["value"] for r in top.collect() for b in r["best"]})
    # The joint vocabulary's counts in every language, so that all histograms share one space.
    joint = {(r["lang"], r["value"]): r["n"] for r in counts.filter(F.col("value").isin(vocabulary)).collect()} if vocabulary else {}
    out: dict = {"words": vocabulary, "classes": {}, "short": {}, "all": {}}
    for r in sorted(classes, key=lambda r: r["__q_lang"]):
        lang = r["__q_lang"]
        if total := sum(r[k] for k in CLASSES):
            out["classes"][lang] = [r[k] / total for k in CLASSES]
        if total := totals.get(lang, 0):
            own = [joint.get((lang, w), 0) for w in vocabulary]
            own.append(total - sum(own))
            out["short"][lang] = [x / total for x in own]
            out["all"][lang] = [x / r["n_words"] for x in (*own, r["n_words"] - total)]
    return out


def _places(words: list[str]) -> tuple[int, int, list[int]]:
    """(shift, slots, table): a table without collisions from a word's hash to its place, from 1."""
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    slots = 64
    while True:
        if slots >= 4 * len(words):
            for shift in range(48):
                at = [(h >> shift) & (slots - 1) for h in hashes]
                if len(set(at)) == len(at):
                    table = [0] * slots
                    for place, slot in enumerate(at, 1):
                        table[slot] = place
                    return shift, slots, table
        slots *= 2


def _half_terms(p: Column, q: Column) -> Column:
    """p log2(2p / (p+q)) + q log2(2q / (p+q)) with 0 log 0 = 0, less q."""
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return term(p) + term(q) - q


def _word_divergence(reference: list[float], kinds: Column, share: Column) -> Column:
    """Of the words present (places and shares) from a reference; absent ones add half their share."""
    q = F.array(*[F.lit(float(x)) for x in reference])
    terms = F.zip_with(kinds, share, lambda k, p: _half_terms(p, F.element_at(q, k)))
    return F.aggregate(terms, F.lit(1.0), lambda s, x: s + x) / 2


def _nearest(divergences: list[Column]) -> Column:
    return F.least(*divergences) if len(divergences) > 1 else divergences[0]


def verdicts(rows: DataFrame, references: dict, rules: QualityRules = ALL_RULES, out_col: str = "__quality") -> DataFrame:
    """`measured` rows with one struct column instead of their working columns: n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_divergence, word_divergence, all_words_divergence.

    A divergence is null where its guard or an empty set of references forbids it, and
    then rejects nothing.  Rows are independent, so repeated rows and ties agree.
    """
    df = rows
    total = F.greatest(_c("n_text"), F.lit(1)).cast("double")
    class_div = [
        sum((_half_terms(_c(k) / total, F.lit(float(q))) for k, q in zip(CLASSES, ref)), F.lit(1.0)) / 2
        for ref in references["classes"].values()
    ]
    df = _with(df, class_div=F.when(_c("n_text") >= rules.min_chars, _nearest(class_div)) if class_div else F.lit(None).cast("double"))
    words, short_refs = references["words"], list(references["short"].values())
    if words and short_refs:
        shift, slots, table = _places(words)
        names = F.array(*[F.lit(x) for x in words])
        slots_of = F.expr(f"array({','.join(map(str, table))})")
        slot = lambda x: F.get(slots_of, F.shiftrightunsigned(F.xxhash64(x), shift).bitwiseAND(F.lit(slots - 1)).cast("int"))
        known = F.filter(F.transform(_c("short"), lambda x: F.struct(x.alias("w"), slot(x).alias("k"))), lambda p: F.coalesce(F.get(names, p["k"] - 1) == p["w"], F.lit(False)))
        df = _with(df, place=F.sort_array(F.transform(known, lambda p: p["k"])), n_short=F.size(_c("short")))
        # All other short words have the place after the vocabulary's; then run lengths.
        df = _with(df, runs=F.filter(F.transform(_c("place"), lambda k, i: F.when((i == 0) | (F.get(_c("place"), i - 1) != k), i)), lambda i: i.isNotNull()))
        n_known, n = F.size(_c("place")), F.greatest(_c("n_short"), F.lit(1)).cast("double")
        share = F.zip_with(_c("runs"), F.slice(_c("runs"), F.lit(2), F.size(_c("runs"))), lambda i, j: F.when(i.isNotNull(), (F.coalesce(j, n_known) - i) / n))
        df = _with(
            df,
            kinds=F.concat(F.transform(_c("runs"), lambda i: F.get(_c("place"), i)), F.array(F.lit(len(words) + 1))),
            share=F.concat(share, F.array((_c("n_short") - n_known) / n)),
        )
        # The same counts as shares of all words; the long words have the place after those.
        n_all = F.greatest(_c("n_words"), F.lit(1)).cast("double")
        df = _with(
            df,
            all_kinds=F.concat(_c("kinds"), F.array(F.lit(len(words) + 2))),
            all_share=F.concat(F.transform(_c("share"), lambda x: x * (_c("n_short") / n_all)), F.array((_c("n_words") - _c("n_short")) / n_all)),
        )
        word_div = [_word_divergence(r, _c("kinds"), _c("share")) for r in short_refs]
        all_div = [_word_divergence(r, _c("all_kinds"), _c("all_share")) for r in references["all"].values()]
        df = _with(
            df,
            word_div=F.when(_c("n_short") >= rules.min_short_words, _nearest(word_div)),
            all_div=F.when(_c("n_words") >= rules.min_all_words, _nearest(all_div)),
        )
    else:
        df = _with(df, word_div=F.lit(None).cast("double"), all_div=F.lit(None).cast("double"))
    failed = (_c("n_words") < rules.min_words) | (100 * _c("n_repeat") > rules.max_repeat_percent * _c("n_words"))
    odd = F.coalesce(_c("class_div") > rules.max_class_divergence, F.lit(False)) | F.coalesce(
        _c("word_div") > rules.max_word_divergence, F.lit(False)
    )
    if rules.max_all_divergence is not None:
        odd = odd | F.coalesce(_c("all_div") > rules.max_all_divergence, F.lit(False))
    result = F.struct(
        _c("n_words").alias("n_words"),
        (_c("n_text") - _c("space")).alias("word_chars"),
        _c("symbol").alias("n_symbols"),
        _c("n_dup").alias("n_dup_lines"),
        _c("n_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~odd).alias("kept"),
        _c("class_div").alias("class_divergence"),
        _c("word_div").alias("word_divergence"),
        _c("all_div").alias("all_words_divergence"),
    )
    return df.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith(RESERVED)], result.alias(out_col))


def with_quality(docs: DataFrame, rules: QualityRules = ALL_RULES, text_col: str = "text", lang_col: str = "lang",
                 out_col: str = "__quality") -> DataFrame:
    """Measure, take the references from the documents themselves, and judge: see `verdicts`."""
    rows = measured(docs, rules, text_col)
    return verdicts(rows, language_references(rows, rules, lang_col), rules, out_col)


# Up to so many digests of rejected texts (32 bytes each) are broadcast.
BROADCAST_DIGESTS = 500_000


def passing(docs: DataFrame, rules: QualityRules = ALL_RULES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, all columns, whose text the rules keep.

    A verdict depends on the text alone, so rejected texts are named by their SHA-256 and
    no text is written on the way."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    narrow = docs.select(digest.alias("__digest"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = measured(narrow, rules, keep_text=False)
    # Written before the filter: pushed below the verdict, the filter would repeat all of it.
    judged = stored(verdicts(rows, language_references(rows, rules), rules).select("__digest", "__quality"), "judged")
    gone = stored(judged.filter("NOT __quality.kept").select("__digest").distinct(), "rejected")
    few = gone.count() <= BROADCAST_DIGESTS
    return docs.join(F.broadcast(gone) if few else gone, digest == F.col("__digest"), "left_anti")
