"""Pre-tokenisation without a regex: a finite-state scan over code-point classes.

The byte-level BPE pattern splits a text into contractions, letter runs, number runs
and symbol runs (each with one leading space at most) and white-space runs.  As an
automaton it has nine states.  Every code point is a transition function on those
states; the functions that can arise by composition form a small monoid, so a function
is one small integer and composing two is one table look-up.  Composition is associative: a
text is cut into blocks, every block is scanned independently (vectorised across
blocks), the block totals are scanned the same way, and the two are combined.  A text's
first code point maps every state to the same one, so one scan serves a whole batch.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import regex

# Code-point classes.  APO2 / APO3 are apostrophes that a contraction of one or two
# letters follows; ELSEWHERE they act like any other symbol.
LETTER, NUMBER, OTHER, SPACE, WHITE, APO2, APO3 = range(7)
N_CLASS = 7
UNKNOWN = 255

# States: what the last code point belonged to.
(BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, AFTER_WHITE, TWO_LEFT, ONE_LEFT, CONTRACTED) = range(9)
N_STATE = 9

# White space as the public tokenizer libraries' \s has it.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# The pattern's contractions.
SHORT_SUFFIXES = "stmd"
LONG_SUFFIXES = ("re", "ve", "ll")


def _target(state: int, cls: int) -> int:
    if state == TWO_LEFT:
        return ONE_LEFT
    if state == ONE_LEFT:
        return CONTRACTED
    if cls in (APO2, APO3):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER
        return ONE_LEFT if cls == APO2 else TWO_LEFT
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE}[cls]


def _opens_token(state: int, cls: int, before_text: bool) -> bool:
    """Whether a code point of class `cls` met in `state` starts a token.

    before_text: a code point other than white space follows it in the same text."""
    if state in (TWO_LEFT, ONE_LEFT):
        return False
    if state in (BEGIN, CONTRACTED):
        return True
    if cls in (SPACE, WHITE):
        return state not in (AFTER_SPACE, AFTER_WHITE) or before_text
    if state == AFTER_SPACE:
        return False
    return state != {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(cls, IN_OTHER)


class _Monoid:
    """Closure of the transition functions under composition, as look-up tables."""

    def __init__(self) -> None:
        moves = [tuple(_target(s, c) for s in range(N_STATE)) for c in range(N_CLASS)]
        fresh = [(m[BEGIN],) * N_STATE for m in moves]
        identity = tuple(range(N_STATE))
        found = {f: i for i, f in enumerate(dict.fromkeys([identity, *moves, *fresh]))}
        queue = list(found)
        for f in queue:  # grows while new functions appear
            for g in moves + fresh:
                h = tuple(g[x] for x in f)
                if h not in found:
                    found[h] = len(found)
                    queue.append(h)
        self.size = size = len(found)
        self.apply = np.array(list(found), np.uint8)
        self.of_class = np.array([found[m] for m in moves + fresh], np.uint16)  # [fresh * N_CLASS + class]
        self.then = np.zeros((size, size), np.uint16)  # [f, g]: first f, then g
        index = {f: i for f, i in found.items()}
        for f, i in found.items():
            for g, j in found.items():
                self.then[i, j] = index[tuple(g[x] for x in f)]
        self.flat = np.ascontiguousarray(self.then).ravel()
        self.identity = found[identity]
        self.opens = np.array(
            [[[_opens_token(s, c, b) for b in (False, True)] for c in range(N_CLASS)] for s in range(N_STATE)]
        ).ravel()


@functools.cache
def monoid() -> _Monoid:
    return _Monoid()


BLOCK = 64


def prefix_compose(fns: np.ndarray) -> np.ndarray:
    """Inclusive scan: out[i] = fns[0] then fns[1] ... then fns[i]."""
    m = monoid()
    n = len(fns)
    if n <= BLOCK:
        out = fns.copy()
        for i in range(1, n):
            out[i] = m.then[out[i - 1], fns[i]]
        return out
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, m.identity, np.uint16)
    grid[:n] = fns
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)  # one row per place in a block
    for k in range(1, BLOCK):
        grid[k] = m.flat[grid[k - 1].astype(np.int32) * m.size + grid[k]]
    totals = prefix_compose(grid[-1].copy())
    carry = np.full(blocks, m.identity, np.int32)
    carry[1:] = totals[:-1]
    out = m.flat[(carry * m.size)[None, :] + grid]
    return np.ascontiguousarray(out.T).ravel()[:n]


_IS = {LETTER: regex.compile(r"\p{L}"), NUMBER: regex.compile(r"\p{N}")}


def unicode_class(points: Sequence[int]) -> list[int]:
    """Classes by Unicode general category (the tables of the `regex` library)."""
    out = []
    for p in points:
        ch = chr(p)
        if p in WHITE_SPACE:
            out.append(SPACE if p == 32 else WHITE)
        else:
            out.append(next((k for k, r in _IS.items() if r.match(ch)), OTHER))
    return out


class Scanner:
    """Token starts of many texts at once.

    `classify` maps code points to classes.  It is asked once per code point that
    occurs, so a library's own tables can be used by probing it.
    """

    def __init__(self, classify: Callable[[Sequence[int]], list[int]] = unicode_class) -> None:
        self.classify = classify
        self.table = np.full(0x110000, UNKNOWN, np.uint8)

    def classes(self, points: np.ndarray) -> np.ndarray:
        cls = self.table[points]
        if (unknown := cls == UNKNOWN).any():
            new = np.unique(points[unknown])
            self.table[new] = self.classify(new.tolist())
            cls = self.table[points]
        return cls

    def starts(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """(joined text, starts of all tokens in it, number of tokens of each text)."""
        joined = "".join(texts)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        if not joined:
            return joined, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        ends = np.cumsum(lengths)
        first = np.zeros(n + 1, bool)
        first[ends - lengths] = True  # an empty text marks its successor's start: the same place
        first = first[:n]
        cls = self.classes(points)
        self._mark_contractions(points, first, cls)
        m = monoid()
        after = m.apply[prefix_compose(m.of_class[cls + N_CLASS * first.astype(np.uint8)]), BEGIN]
        state = np.empty(n, np.uint16)
        state[0] = BEGIN
        state[1:] = after[:-1]
        state[first] = BEGIN
        white = (cls == SPACE) | (cls == WHITE)
        before_text = np.zeros(n, bool)
        before_text[:-1] = ~white[1:] & ~first[1:]
        opens = m.opens[(state * N_CLASS + cls) * 2 + before_text]
        counts = np.concatenate([[0], np.cumsum(opens)])
        return joined, np.flatnonzero(opens), counts[ends] - counts[ends - lengths]

    @staticmethod
    def _mark_contractions(points: np.ndarray, first: np.ndarray, cls: np.ndarray) -> None:
        at = np.flatnonzero(points == 39)
        if not len(at):
            return
        n = len(points)
        p1 = np.where(at + 1 < n, points[np.minimum(at + 1, n - 1)], 0)
        p1[(at + 1 < n) & first[np.minimum(at + 1, n - 1)]] = 0
        p2 = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        p2[(at + 2 < n) & first[np.minimum(at + 2, n - 1)]] = 0
        cls[at[np.isin(p1, [ord(c) for c in SHORT_SUFFIXES])]] = APO2
        for a, b in LONG_SUFFIXES:
            cls[at[(p1 == ord(a)) & (p2 == ord(b))]] = APO3

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, start and end of every token in them, tokens of each text)."""
        joined, starts, counts = self.starts(texts)
        data = joined.encode("utf-8", "surrogatepass")
        if len(data) > len(joined):
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            width = np.ones(len(points), np.int8)
            for limit in (0x7F, 0x7FF, 0xFFFF):
                width += points > limit
            starts = (np.cumsum(width, dtype=np.int64) - width)[starts]
        return data, starts, np.append(starts[1:], len(data))[: len(starts)], counts

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """(token slices of all texts in order, number of them for each text)."""
        data, starts, ends, counts = self.slices(texts)
        return [data[i:j] for i, j in zip(starts.tolist(), ends.tolist())], counts
