"""Operator 5: token counts, with overlap resynchronisation of huge documents.

Counts are those of a `tokenizers` JSON file (byte-level BPE).  A short text is split
by the class scan and every distinct slice is counted once by the library and cached:
byte-level BPE never merges across the scan's boundaries.  A huge text is encoded in
overlapping chunks with offsets; two chunks are spliced at a place where both have a
token boundary that no context outside the overlap can move, and the overlap is
widened while there is none.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow import map_texts
from .scan import LETTER, NUMBER, OTHER, SPACE, WHITE, Scanner
from .slices import SliceCache

HUGE_CHARS = 65_536
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256


def probe_classes(tokenizer) -> Callable:
    """Code-point classes as the library's own pre-tokenizer has them.

    c joins a letter run, a number run or a symbol run if it is of that kind; what joins
    none of them is white space."""

    def classify(points):
        points = list(points)
        text = "".join(f"a{chr(p)}\n1{chr(p)}\n!{chr(p)}\n" for p in points)
        starts = {span[0] for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        out = []
        for k, p in enumerate(points):
            at = 9 * k + 1
            joined = [kind for kind, i in ((LETTER, at), (NUMBER, at + 3), (OTHER, at + 6)) if i not in starts]
            out.append(joined[0] if joined else SPACE if p == 32 else WHITE)
        return out

    return classify


class Counter:
    """Token counts of one tokenizer file."""

    def __init__(self, path: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.scanner = Scanner(probe_classes(self.tokenizer))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = max([1, *map(len, self.special)])
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.cache = SliceCache(self._count_pieces)
        self.widened = 0

    def _count_pieces(self, pieces: list[bytes]) -> list[tuple[int]]:
        encoded = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [(len(e),) for e in encoded]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of tokens of every text."""
        out: list[int | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if len(t) > self.huge:
                out[i] = self.count_huge(t)
            elif any(s in t for s in self.special):
                out[i] = len(self.tokenizer.encode(t, add_special_tokens=False))
            else:
                plain.append(i)
        data, starts, ends, numbers = self.scanner.slices([texts[i] for i in plain])
        tokens, _ = self.cache.gather(data, starts, ends)
        before = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
        last = np.cumsum(numbers)
        for i, n in zip(plain, (before[last] - before[last - numbers]).tolist()):
            out[i] = n
        return out

    def _stable(self, text: str, p: int) -> bool:
        """Whether every tokenisation has a boundary at p, whatever stands further off.

        A token is a run of one class with at most one leading space, or a contraction
        (apostrophe, letters).  So white space after something else always starts a
        token, and so do changes between letters, numbers and symbols unless an
        apostrophe stands before."""
        a, b = (int(c) for c in self.scanner.classify([ord(text[p - 1]), ord(text[p])]))
        if a in (SPACE, WHITE):
            return False
        return b in (SPACE, WHITE) or (a != b and text[p - 1] != "'")

    def _starts(self, text: str, lo: int, hi: int) -> dict[int, int]:
        """Start offset of each pre-token in text[lo:hi] -> number of tokens before it.

        The library's offsets leave out a token's leading white space, so a start is
        taken where the previous token ends."""
        spans = self.tokenizer.encode(text[lo:hi], add_special_tokens=False).offsets
        out = {lo: 0}
        for k, ((_, end), (start, _)) in enumerate(zip(spans, spans[1:]), 1):
            if start >= end:  # else both hold bytes of one character
                out[lo + end] = k
        self._total = len(spans)
        return out

    def _splice(self, text: str, left: dict[int, int], right: dict[int, int], lo: int, hi: int) -> int | None:
        """A common stable boundary of both encodings in the overlap [lo, hi), far enough
        from its ends that a special token's string across it lies inside."""
        for p in sorted(left.keys() & right.keys(), reverse=True):
            if lo + self.margin < p < hi - self.margin and self._stable(text, p):
                return p
        return None

    def count_huge(self, text: str) -> int:
        """Tokens of a long text from overlapping chunks."""
        n = len(text)
        lo, hi = 0, min(self.chunk, n)
        left = self._starts(text, lo, hi)
        left_total, base, total = self._total, 0, 0  # base: tokens of this chunk before its splice
        while hi < n:
            overlap, start = self.overlap, hi
            while True:
                start = max(lo, hi - overlap)
                end = min(n, max(hi + self.chunk, start + self.chunk))
                right = self._starts(text, start, end)
                right_total = self._total
                p = self._splice(text, left, right, start, hi)
                if p is not None and p > lo:
                    total += left[p] - base
                    base, left, left_total, lo, hi = right[p], right, right_total, start, end
                    break
                self.widened += 1
                if start > lo:
                    overlap *= 2
                    continue
                # No stable boundary in the whole chunk: grow it, twice as far each time.
                hi = min(n, lo + 2 * (hi - lo))
                grown = self._starts(text, lo, hi)
                left, left_total = grown, self._total
                if hi == n:
                    break
                overlap = self.overlap
        return total + left_total - base


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows give repeated
    results; other columns are not read.
    """

    def task():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = counter.counts(texts)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    return map_texts(docs, task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
