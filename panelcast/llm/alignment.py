"""Operator 13: alignment of two tokenizers over exact-distinct texts.

Rows are shuffled by their full text, so that every distinct text is tokenised and
aligned once, whatever the number of its copies.  Places where tokens of both sides end
cut a text into groups; two tokens are linked where their bytes overlap.  Pair counts
are sums over the distinct texts, weighted by their copies, and the measures of a text
are joined to the rows that hold it.

In a task texts are cut before each space that follows something other than white
space.  There both tokenizers have a boundary (checked on the second one's vocabulary),
so a cut piece is encoded and aligned alone, and the pieces met so far are kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import bounded
from .store import stored

# \S leaves out at least what either tokenizer takes for white space.
CUT = re.compile(r"(?<=\S) ")
SPACE_MARK = "▁"
# Characters of the pieces that a task keeps at most.
KEPT_CHARS = 16 << 20
# Pair counts of up to so many rows (two longs and a flag each) are broadcast.
BROADCAST_PAIRS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the
    other bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.int64, int(sizes.sum())), sizes


class Vocabulary:
    """Bytes of every id."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def __len__(self) -> int:
        return len(self.tokens)

    def join(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Aligner:
    """Ids, groups and links of texts under a byte-level `tokenizers` file (A) and a
    `sentencepiece` model (B)."""

    def __init__(self, a_path: str, b_path: str, kept_chars: int = KEPT_CHARS) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        added = self.a.get_added_tokens_decoder()
        size = self.a.get_vocab_size(with_added_tokens=True)
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_vocab = Vocabulary(
            [s.encode() if i in added else bytes(alphabet[c] for c in s) for i, s in enumerate(names)]
        )
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_vocab = Vocabulary(
            [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        )
        # A piece of B that goes on past a space would span a cut.
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        space = self.b.piece_to_id(SPACE_MARK)
        self.lone_space = [] if space == self.b.unk_id() else [space]
        self.kept_chars = kept_chars
        self._reset()

    def _reset(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.strings: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links, whether aligned
        self.offsets = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def _encoded(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1) if pieces else []
        return a, [ids if p else self.lone_space for p, ids in zip(pieces, b)]

    def align(self, pieces: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(numbers, group strings, links one after the other) of each " " + piece, aligned whole.

        A piece whose bytes either side does not give back is marked as not aligned."""
        a, b = self._encoded(pieces)
        good = []
        for p, x, y in zip(pieces, a, b):
            raw = b" " + p.encode("utf-8", "surrogatepass")
            good.append(self.a_vocab.join(x) == raw and self.b_vocab.join(y) == raw)
        a = [x if ok else [] for x, ok in zip(a, good)]
        b = [y if ok else [] for y, ok in zip(b, good)]
        (a_ids, a_sizes), (b_ids, b_sizes) = _flat(a), _flat(b)
        a_ends, b_ends = np.cumsum(self.a_vocab.lengths[a_ids]), np.cumsum(self.b_vocab.lengths[b_ids])
        a_last, b_last = np.cumsum(a_sizes), np.cumsum(b_sizes)
        piece_ends = np.concatenate([[0], a_ends])[a_last]
        # Between two neighbouring ends lies a stretch of one token of each side: a link.
        ends = np.union1d(a_ends, b_ends)
        in_a, in_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        codes = a_ids[in_a] * len(self.b_vocab) + b_ids[in_b]
        common = (a_ends[in_a] == ends) & (b_ends[in_b] == ends) if len(ends) else np.zeros(0, bool)
        upto = np.searchsorted(ends, piece_ends, side="right")
        links = np.diff(np.concatenate([[0], upto]))
        groups = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(common)])[upto]]))
        numbers = np.stack([a_sizes, b_sizes, groups, links, np.array(good, np.int64)], axis=1).astype(np.int64)
        a_cut, b_cut = (in_a[common] + 1).tolist(), (in_b[common] + 1).tolist()
        a_names, b_names = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        parts = [
            ",".join(a_names[i:j]) + "|" + ",".join(b_names[k:m])
            for i, j, k, m in zip([0, *a_cut], a_cut, [0, *b_cut], b_cut)
        ]
        stop = np.cumsum(groups).tolist()
        return numbers, [";".join(parts[i:j]) for i, j in zip([0, *stop], stop)], codes

    def _learn(self, pieces: list[str]) -> None:
        numbers, strings, links = self.align(pieces)
        for p in pieces:
            self.place[p] = len(self.place)
            self.chars += len(p) + 16
        self.strings += strings
        self.numbers = np.concatenate([self.numbers, numbers])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(numbers[:, 3])])
        self.links = np.concatenate([self.links, links])

    def measure(self, texts: list[str]) -> list[tuple]:
        """(tokens of A, of B, groups, links, digest of the groups, distinct links, times of each) of
        " " + text; zeros, "" and no links where the text has no tokens."""
        if self.chars > self.kept_chars:
            self._reset()
        cut = [CUT.split(t) if self.cuts and t else [t] for t in texts]
        missing = dict.fromkeys(p for pieces in cut for p in pieces if p not in self.place)
        if missing:
            self._learn(list(missing))
        out = []
        for text, pieces in zip(texts, cut):
            if not text:
                out.append(NOTHING)
                continue
            at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
            if self.numbers[at, 4].all():
                used, times = np.unique(at, return_counts=True)
                sizes = self.numbers[used, 3]
                ends = np.cumsum(sizes)
                where = np.repeat(self.offsets[used] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
                found, weights = self.links[where], np.repeat(times, sizes)
                numbers, string = self.numbers[at, :4].sum(axis=0), ";".join([self.strings[i] for i in at.tolist()])
            else:  # some piece does not give back its bytes; the whole text decides
                whole, strings, found = self.align([text])
                if not whole[0, 4]:
                    out.append(NOTHING)
                    continue
                numbers, string, weights = whole[0, :4], strings[0], np.ones(len(found), np.int64)
            codes, back = np.unique(found, return_inverse=True)
            times = np.bincount(back, weights=weights, minlength=len(codes)).astype(np.int64)
            out.append((*numbers.tolist(), hashlib.sha256(string.encode()).hexdigest(), codes, times))
        return out


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
ALIGNED = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<long>"


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, key: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """One row per distinct text that is not empty: its key, copies, numbers, and the distinct
    links (id of A times the size of B's vocabulary, plus id of B) with their times."""
    text = F.col(text_col).cast("string")
    # The full text is the grouping key: copies meet in the map-side part already, so a text
    # that a third of all rows hold reaches the exchange as one row a task.
    distinct = docs.select(text.alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for part in bounded(batch, text_at=2):
                rows = aligner.measure(part.column(2).to_pylist())
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), *(pa.array(columns[i], pa.int64()) for i in range(4)),
                        pa.array(columns[4], pa.string()), _arrays(columns[5]), _arrays(columns[6]),
                    ],
                    names=["key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"],
                )

    return distinct.select(key(F.col("text")).alias("key"), "copies", "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """link, count (corpus-wide, every copy counted), best (0 or 1: the highest count of its id of B)."""
    each = aligned.select("copies", F.inline(F.arrays_zip("links", "times")))
    counts = stored(each.groupBy(F.col("links").alias("link")).agg(F.sum(F.col("times") * F.col("copies")).alias("count")), "pair-counts")
    # One row for each id of B: bounded by its vocabulary.
    top = counts.groupBy(F.pmod("link", F.lit(b_size)).alias("b")).agg(F.max("count").alias("top"))
    return (
        counts.join(F.broadcast(top), F.pmod("link", F.lit(b_size)) == F.col("b"))
        .select("link", "count", (F.col("count") == F.col("top")).cast("int").alias("best"))
    )


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
              key: Callable[[Column], Column] = _sha256) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Null and empty texts, and those whose bytes a side does not give back, have no tokens:
    zeros and ''.  Special tokens' strings are plain text.  Repeated rows count each and
    give repeated results; null ids stay; other columns are not read; an empty table gives
    no rows.  `key` shortens texts for the joins; should two texts share one, the texts
    themselves are the key instead.
    """
    import sentencepiece

    b_size = len(sentencepiece.SentencePieceProcessor(model_file=b_path))
    aligned = stored(aligned_texts(docs, a_path, b_path, key, text_col), "aligned", compression="zstd")
    if not aligned.groupBy("key").count().filter("count > 1").isEmpty():
        return alignment(docs, a_path, b_path, id_col, text_col, key=lambda text: text.cast("binary"))
    counts = stored(pair_counts(aligned, b_size), "pair-best")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    sums = (
        aligned.select("key", F.inline(F.arrays_zip("links", "times"))).join(counts, F.col("links") == F.col("link"))
        .groupBy("key").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    )
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    measures = stored(aligned.select("key", *numbers, "groups_sha256").join(sums, "key", "left"), "measures")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    # Both sides are exchanged by the join alone: a text with very many copies is split at run time.
    return rows.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*numbers, "n_best", "count_sum")],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )
