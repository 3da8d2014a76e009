"""Operator 2: toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (learned from labelled documents, with weights), words of
intent, violence, targets, negation, reported speech, quotation marks and clause ends.
Four small transducers read the symbols side by side: the scope of a negation, reported
or quoted speech, whether a target has been named, and how far a threat has come
(intent, violence, target).  They are composed into one table.  What counts is a
clause's matched weight: an insult counts less when negated or reported and more with a
target; a threat counts when it is complete.  Some stems are insults only when a text
insists on them: their words come twice or more and make up a learned part of the text,
while a single one may be chance.  A logistic function of the clause scores, fitted on
labelled documents, gives the score.
"""

from __future__ import annotations

import collections
import itertools
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts
from .store import stored

NONE, INSULT, INTENT, VIOLENCE, TARGET, NEGATION, REPORT, QUOTE, END = range(9)
N_SYMBOLS = 9

# Fixed word lists of the grammar (English, German, French, Spanish).
WORDS = {
    INTENT: "will gonna going shall must should werde werden wird vais va voy vamos",
    VIOLENCE: "kill hurt destroy beat burn stab shoot töten schlagen verletzen tuer frapper mourir matar golpear morir",
    TARGET: "you your yours u they them he she him her his people du dich dir ihr euch sie tu te toi vous eux tú ti usted ustedes ellos",
    NEGATION: "not never no isn aren don won nicht kein keine niemals nie pas jamais aucun nunca jamás tampoco",
    REPORT: "said says say called calls wrote writes claimed claims reported quoted sagte schrieb nannte dit écrit dijo escribió llamó",
}
# Insults known beforehand, with the weight of a word that has yet to be learned.
SEED_INSULTS = "idiot moron stupid worthless pathetic disgusting scum trash loser clown dumb imbecile"

NEGATION_SCOPE = 3
TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n\"“”«»]")


@dataclass(frozen=True)
class ToxicSettings:
    # Bound of the learning sample: expected documents of each label.
    sample_per_label: int = 8_000
    lexicon_size: int = 4_000
    # A feature must be commoner in toxic documents by this factor (its logarithm), and so
    # clearly that chance would hardly lift even one of all features there.
    min_log_odds: float = 2.5
    chance: float = 0.1
    stems: tuple[int, ...] = (4, 5, 6)
    # A text insists on a stem if it begins so many of its words, and this part of them.
    insist_words: int = 2
    insist_share: float = 0.008
    seed_weight: float = 4.0
    negated: float = 0.5
    reported: float = 0.6
    targeted: float = 1.3
    threat_weight: float = 5.0
    ridge: float = 1e-3


# ---- the transducers: (state, symbol) -> state --------------------------------------


def _negation(state: int, symbol: int) -> int:
    if symbol == END:
        return 0
    return NEGATION_SCOPE if symbol == NEGATION else max(0, state - 1)


def _report(state: int, symbol: int) -> int:
    """0 own words, 1 reported, 2 inside quotation marks."""
    if symbol == QUOTE:
        return 0 if state == 2 else 2
    if symbol == END:
        return 2 if state == 2 else 0
    return 1 if symbol == REPORT and state == 0 else state


def _target(state: int, symbol: int) -> int:
    return 0 if symbol == END else 1 if symbol == TARGET else state


def _threat(state: int, symbol: int) -> int:
    """0 nothing, 1 intent, 2 intent and violence, 3 complete."""
    if symbol == END:
        return 0
    step = {(0, INTENT): 1, (1, VIOLENCE): 2, (2, TARGET): 3}
    return step.get((state, symbol), state)


PARTS = ((_negation, NEGATION_SCOPE + 1), (_report, 3), (_target, 2), (_threat, 4))


def compose() -> tuple[list[tuple], list[list[int]]]:
    """(product states, table[state][symbol] -> state) of the four transducers."""
    states = list(itertools.product(*(range(n) for _, n in PARTS)))
    at = {s: i for i, s in enumerate(states)}
    table = [[at[tuple(f(x, symbol) for (f, _), x in zip(PARTS, s))] for symbol in range(N_SYMBOLS)] for s in states]
    return states, table


class Lexicon(dict):
    """word -> (symbol, weight); the cache of unknown words is emptied when full."""

    LIMIT = 200_000

    def __init__(self, insults: dict[str, float], stems: dict[str, float], lengths: tuple[int, ...]) -> None:
        super().__init__()
        self.base: dict[str, tuple[int, float]] = {c: (END, 0.0) for c in ".!?;\n"} | {c: (QUOTE, 0.0) for c in '"“”«»'}
        for symbol, words in WORDS.items():
            self.base |= {w: (symbol, 0.0) for w in words.split()}
        self.base |= {w: (INSULT, x) for w, x in insults.items()}
        self.stems, self.lengths = stems, lengths
        self.update(self.base)

    def __missing__(self, word: str):
        weight = max((self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) >= n), default=0.0)
        value = (INSULT, weight) if weight else None
        if len(self) > self.LIMIT:
            self.clear()
            self.update(self.base)
        self[word] = value
        return value


class StemsOf(dict):
    """word -> its stems that are of interest; emptied when full."""

    LIMIT = 200_000

    def __init__(self, lengths: tuple[int, ...], known: dict[str, float] | None) -> None:
        super().__init__()
        self.lengths, self.known = lengths, known

    def __missing__(self, word: str) -> tuple[str, ...]:
        value = tuple(word[:n] for n in self.lengths if len(word) >= n and (self.known is None or word[:n] in self.known))
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = value
        return value


def insisted_stems(tokens: list[str], stems_of: StemsOf, settings: ToxicSettings) -> set[str]:
    """The stems that a text, given as its tokens, insists on."""
    times = collections.Counter(itertools.chain.from_iterable(map(stems_of.__getitem__, tokens)))
    least = max(settings.insist_words, settings.insist_share * len(tokens))
    return {stem for stem, n in times.items() if n >= least}


class Grammar:
    """Clause scores of texts."""

    def __init__(
        self, insults: dict[str, float], stems: dict[str, float], settings: ToxicSettings, insisted: dict[str, float] | None = None
    ) -> None:
        self.settings = settings
        self.lexicon = Lexicon(insults, stems, settings.stems)
        self.insisted = insisted or {}
        self.stems_of = StemsOf(settings.stems, self.insisted)
        self.states, self.table = compose()

    def symbols(self, tokens: list[str]) -> tuple[list, float]:
        """(symbol and weight of every token, None for none; weight of the heaviest stem insisted on)."""
        lexicon = self.lexicon
        found = [lexicon[w] for w in tokens]
        said = insisted_stems(tokens, self.stems_of, self.settings) if self.insisted else ()
        if not said:
            return found, 0.0
        for i, w in enumerate(tokens):
            weight = max((self.insisted[p] for p in self.stems_of[w] if p in said), default=0.0)
            if weight and (found[i] is None or found[i][0] == INSULT and found[i][1] < weight):
                found[i] = (INSULT, weight)
        return found, max(self.insisted[p] for p in said)

    def clauses(self, text: str) -> tuple[list[float], float, int, float]:
        """(weight of every clause in which something matched, heaviest match, number of
        tokens, weight of the heaviest stem insisted on)."""
        s, table, states = self.settings, self.table, self.states
        found, insistence = self.symbols(TOKENS.findall(text.lower()))
        marks = [(i, v) for i, v in enumerate(found) if v is not None]
        if not any(v[0] in (INSULT, VIOLENCE) for _, v in marks):
            return [], 0.0, len(found), 0.0
        out, state, score, last = [], 0, 0.0, -1
        for i, (symbol, weight) in itertools.chain(marks, [(len(found), (END, 0.0))]):
            for _ in range(min(i - last - 1, NEGATION_SCOPE)):  # words between only use up a negation
                state = table[state][NONE]
            last = i
            negation, report, target, threat = states[state]
            if symbol == INSULT:
                score += weight * (s.negated if negation else 1.0) * (s.reported if report else 1.0)
            elif symbol == TARGET and threat == 2:
                score += s.threat_weight * (s.negated if negation else 1.0) * (s.reported if report else 1.0)
            elif symbol == END and score:
                out.append(score * (s.targeted if target else 1.0))
                score = 0.0
            state = table[state][symbol]
        return out, max(weight for _, (_, weight) in marks), len(found), insistence

    def features(self, text: str) -> list[float]:
        """Best clause, all clauses together, how many matched, the heaviest match, the
        length of the text, since a long one meets a doubtful word sooner, and the heaviest
        stem insisted on; zeros without a match."""
        c, heaviest, tokens, insistence = self.clauses(text)
        if not c:
            return [0.0] * N_FEATURES
        return [math.log1p(max(c)), math.log1p(sum(c)), math.log1p(len(c)), heaviest, math.log1p(tokens), insistence]


N_FEATURES = 6


@dataclass
class ToxicModel:
    insults: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    settings: ToxicSettings = field(default_factory=ToxicSettings)
    insisted: dict[str, float] = field(default_factory=dict)

    def scores(self, grammar: Grammar, texts: list[str]) -> list[float]:
        w = self.weights
        out = []
        for t in texts:
            z = float(w[0] + np.dot(w[1:], grammar.features(t)))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (bias first) by Newton steps on the penalised log-likelihood."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * len(x) * np.eye(len(w))
    penalty[0, 0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (sample_weight * (p - y)) + penalty @ w
        hess = (x * (sample_weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, settings: ToxicSettings = ToxicSettings(),
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learn the insult lexicon and the logistic weights from labelled rows.

    `learnable` is a condition on the id column.  The sample is bounded by
    `sample_per_label`; labels are counted over all learnable rows, so the weights keep
    the true share of toxic documents.  Copies and most near copies of a text count
    once: their words would else look like signs of its label.  Nulls in ids, texts or
    labels are left out.
    """
    known = labels.filter(learnable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")
    )
    total = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.coalesce(*[F.when(F.col("__y") == y, F.lit(min(1.0, settings.sample_per_label / n))) for y, n in total.items()], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Bounded by the sample, so the broadcast is small whatever the tables hold.
    picked = F.broadcast(known.filter(draw < chance).groupBy("__id").agg(F.max("__y").alias("__y")))
    text = F.lower(F.col(text_col).cast("string"))
    sample = stored(
        docs.select(F.col(id_col).alias("__id"), text.alias("text")).join(picked, "__id").filter(F.col("text").isNotNull())
        .select(F.col("__y").alias("y"), "text").withColumn("words", F.split("text", " "))
        .groupBy(_copy_key("words").alias("h")).agg(F.max("y").alias("y"), F.max("text").alias("text")),
        "toxic-sample",
    )
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    seeds = {w: settings.seed_weight for w in SEED_INSULTS.split()}
    insults, stems, insisted = dict(seeds), {}, {}
    if n1 and n0:
        words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)))
        pieces = [F.transform(words, lambda w: F.concat(F.lit("w"), w))] + [
            F.transform(F.filter(words, _at_least(k)), _stem_of(k)) for k in settings.stems
        ]
        rows = sample.select("y", F.explode(F.array_distinct(F.concat(*pieces))).alias("f"))
        repeated = map_texts(sample, _insistence(settings), "y long, f array<string>", "y", "text")
        rows = rows.unionByName(repeated.select(F.col("y").cast("int"), F.explode("f").alias("f")))
        counts = stored(rows.groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")), "toxic-features")
        odds = F.ln((F.col("a") + 0.5) / F.lit(n1 + 1.0)) - F.ln((F.col("b") + 0.5) / F.lit(n0 + 1.0))
        # Log-likelihood ratio of the feature's own share of toxic documents against the sample's.
        both, part = F.col("a") + F.col("b"), n1 / (n0 + n1)
        gain = F.col("a") * F.ln(F.col("a") / both / part) + F.when(
            F.col("b") > 0, F.col("b") * F.ln(F.col("b") / both / (1 - part))
        ).otherwise(0.0)
        needed = math.log(max(1, counts.count()) / settings.chance)
        chosen = (
            counts.filter("a > 0").withColumn("odds", odds).withColumn("gain", gain)
            .filter((F.col("odds") >= settings.min_log_odds) & (F.col("gain") >= needed))
            .orderBy(F.col("gain").desc(), "f").limit(settings.lexicon_size).collect()
        )
        for r in chosen:
            {"w": insults, "s": stems, "i": insisted}[r["f"][0]][r["f"][1:]] = float(r["odds"])
    model = ToxicModel(insults, stems, np.zeros(1 + N_FEATURES), settings, insisted)
    if not (n1 and n0):
        model.weights = np.array([-4.0, 2.0, 1.0, 0.5, 0.2, 0.0, 0.0])  # nothing to learn from
        return model

    def task():
        grammar = Grammar(insults, stems, settings, insisted)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = [grammar.features(t or "") for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["y", "x"])

        return step

    seen = map_texts(sample, task, "y long, x array<double>", "y", "text").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
    # The sample's labels weigh as much as they do among all labelled rows.
    share = {k: total[k] / size[k] for k in size}
    weight = np.array([share[int(v)] for v in y])
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows come in
    model.weights = fit_logistic(x[order], y[order], weight[order] / weight.mean(), settings.ridge)
    return model


def _insistence(settings: ToxicSettings):
    """Task that gives, for every text, the stems it insists on, marked as such features."""

    def task():
        stems_of = StemsOf(settings.stems, None)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [
                sorted("i" + p for p in insisted_stems(TOKENS.findall((t or "").lower()), stems_of, settings) if p[0].isalpha())
                for t in batch.column(1).to_pylist()
            ]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["y", "f"])

        return step

    return task


def _copy_key(words: str) -> Column:
    """Least hash of a text's three-word shingles: alike for copies, and mostly for near copies."""
    words = F.col(words)
    return F.array_min(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))


def _at_least(k: int):
    return lambda w: F.char_length(w) >= k


def _stem_of(k: int):
    return lambda w: F.concat(F.lit("s"), F.substring(w, 1, k))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the whole text is read, null as empty.

    A text without a match, empty ones included, has the score of no clause.  Repeated
    rows agree; no other column is read.
    """
    insults, stems, settings, insisted = model.insults, model.stems, model.settings, model.insisted

    def task():
        grammar = Grammar(insults, stems, settings, insisted)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.scores(grammar, [t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return step

    return map_texts(docs, task, "doc_id long, score double", id_col, text_col)
