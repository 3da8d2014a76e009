"""Operator 8: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character two- and three-grams of the lower-cased
text, anything but letters read as a space.  Document frequencies are counted over all
learning documents; weights are fitted with follow-the-regularised-leader and an
elastic net on a bounded sample of them, and a temperature is fitted on a part of the
sample that the weights have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, map_texts
from .scan import LETTER, Scanner

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangSettings:
    buckets_log2: int = 14
    # Bound of the fitting sample: expected documents of each language.
    sample_per_language: int = 3_000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    calibration_part: int = 5  # every fifth sampled document calibrates


class NGrams:
    """Hashed n-gram counts of texts."""

    def __init__(self, buckets_log2: int) -> None:
        self.log2 = buckets_log2
        self.scanner = Scanner()

    def counts(self, texts: list[str]):
        """Yield (has a letter, counts by bucket) for every text.

        A text is framed by spaces, so no n-gram reaches into the next."""
        framed = [f" {t.lower()}  " for t in texts]
        points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.scanner.classes(points) == LETTER
        p = np.where(letter, points, 32).astype(np.uint64)
        shift = np.uint64(64 - self.log2)
        two = (p[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        three = (two[:-1] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ (p[2:] * np.uint64(0xA0761D6478BD642F))
        two = ((two * np.uint64(0xFF51AFD7ED558CCD)) >> shift).astype(np.int64)
        three = ((three * np.uint64(0xFF51AFD7ED558CCD)) >> shift).astype(np.int64)
        # Runs of spaces say nothing.
        blank = (p[:-1] == 32) & (p[1:] == 32)
        size, at = 1 << self.log2, 0
        for t in framed:
            end = at + len(t)
            keep = ~blank[at : end - 2]
            c = np.bincount(two[at : end - 2][keep], minlength=size) + np.bincount(three[at : end - 2][keep], minlength=size)
            yield bool(letter[at:end].any()), c
            at = end


def _weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, x / norm if norm else x


@dataclass
class LangModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    settings: LangSettings = field(default_factory=LangSettings)

    def predict(self, grams: NGrams, texts: list[str]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for some, counts in grams.counts(texts):
            if not some or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            at, x = _weights(counts, self.idf)
            z = (x @ self.weights[at] + self.bias) / self.temperature
            e = np.exp(z - z.max())
            best = int(e.argmax())
            names.append(self.languages[best])
            scores.append(float(e[best] / e.sum()))
        return names, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, s: LangSettings) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of multinomial logistic regression, one pass per epoch in the given order.

    A bias is an extra feature of value 1, without the l1 penalty."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    l1 = np.full((size + 1, 1), s.l1)
    l1[size] = 0.0

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1[at], 0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for at, x, y in examples:
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size], w[size]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature of least negative log-likelihood, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, learnable: Column, settings: LangSettings = LangSettings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Learn from the rows of `docs` that `learnable` picks and whose language is not null."""
    known = docs.filter(learnable & F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    log2, buckets = settings.buckets_log2, 1 << settings.buckets_log2

    def frequencies(batches):
        grams, total, docs_seen = NGrams(log2), np.zeros(buckets, np.int64), 0
        for batch in batches:
            for part in bounded(batch):
                for some, counts in grams.counts([t or "" for t in part.column(1).to_pylist()]):
                    total += counts > 0
                    docs_seen += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs_seen), pa.int64())], names=["bucket", "n"]
        )

    counted = known.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(frequencies, "bucket int, n long")
    rows = {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n_docs = rows.pop(-1, 0)
    df = np.zeros(buckets)
    for b, n in rows.items():
        df[b] = n
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    chance = F.coalesce(*[F.when(F.col(lang_col) == x, F.lit(min(1.0, settings.sample_per_language / sizes[x]))) for x in languages], F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def task():
        grams = NGrams(log2)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out_at, out_x = [], []
            for _, counts in grams.counts([t or "" for t in batch.column(1).to_pylist()]):
                at = np.flatnonzero(counts)
                out_at.append(at.astype(np.uint16 if log2 <= 16 else np.uint32).tobytes())
                out_x.append(np.minimum(counts[at], 65535).astype(np.uint16).tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out_at, pa.binary()), pa.array(out_x, pa.binary())], names=["doc_id", "lang", "at", "x"])

        return step

    picked = known.filter(draw < chance)
    sample = map_texts(picked, task, "doc_id long, lang string, at binary, x binary", id_col, text_col, [F.col(lang_col).cast("string").alias("lang")]).collect()
    sample.sort(key=lambda r: (hash_order(r["doc_id"]), r["lang"]))
    kind = np.uint16 if log2 <= 16 else np.uint32
    examples = []
    for r in sample:
        counts = np.zeros(buckets, np.int64)
        counts[np.frombuffer(r["at"], kind)] = np.frombuffer(r["x"], np.uint16)
        examples.append((*_weights(counts, idf), languages.index(r["lang"])))
    if not examples:
        return LangModel([], idf, np.zeros((buckets, 0)), np.zeros(0), 1.0, settings)
    held = examples[:: settings.calibration_part] if len(examples) >= 10 else []
    learn = [e for i, e in enumerate(examples) if not held or i % settings.calibration_part]
    weights, bias = fit_ftrl(learn, buckets, len(languages), settings)
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]) if held else np.zeros((0, len(languages)))
    return LangModel(languages, idf, weights, bias, fit_temperature(logits, np.array([y for *_, y in held], int)), settings)


def hash_order(doc_id: int | None) -> int:
    """A fixed shuffle of ids, the same on every run."""
    return ((doc_id or 0) * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row: `und` with score 0 for null texts and texts without a letter.

    Also `und` where nothing could be learned.  Repeated rows agree; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def task():
        grams = NGrams(shared.value.settings.buckets_log2)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = shared.value.predict(grams, [t or "" for t in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return step

    return map_texts(docs, task, "doc_id long, lang_pred string, score double", id_col, text_col)
