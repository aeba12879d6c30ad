"""Partial similarity of a short needle against text cells.

Score of two texts: 100 * 2*LCS / (n + w), where n is the length of the shorter text and w the
length of a window of the longer one, maximal over all windows of length n and the shorter windows
at its two ends. Both texts are lower-cased. Spark partitions the rows; inside a task a whole Arrow
batch is scored at once with the bit-parallel LCS recurrence (Hyyrö 2004), one machine word per
window, so there is no per-row Python loop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens import fields

_WORD_BITS = 64
_BLOCK = 1 << 15      # windows scored at a time: their state stays in the processor cache
_BATCH = 1 << 20      # characters held at a time: bounds task memory


def _advance(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One step of the LCS recurrence; zero bits of the state count the matched characters."""
    hit = state & mask
    return (state + hit) | (state - hit)


def _zeros(state: np.ndarray, keep) -> np.ndarray:
    if state.dtype == object:
        return np.array([int.bit_count(~s & keep) for s in state], dtype=np.int64)
    return np.bitwise_count(~state & keep).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class _Needle:
    """Character masks of the needle, one bit per position."""

    def __init__(self, needle: str):
        self.size = len(needle)
        # needles beyond one machine word fall back to Python integers: slower, same recurrence
        self.dtype = np.uint64 if self.size <= _WORD_BITS else object
        self.full = (1 << self.size) - 1
        self.start = self._const((1 << _WORD_BITS) - 1 if self.dtype != object else self.full)
        bits: dict[int, int] = {}
        for i, code in enumerate(_codes(needle)):
            bits[int(code)] = bits.get(int(code), 0) | (1 << i)
        self.codes = np.array(sorted(bits), dtype=np.uint32)
        self.bits = np.array([bits[int(k)] for k in self.codes] + [0], dtype=self.dtype)

    def _const(self, value: int):
        return np.uint64(value) if self.dtype != object else value

    def masks(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        return self.bits[np.where(known, at, len(self.codes))]

    def over_long_cells(self, cells: list[np.ndarray]) -> np.ndarray:
        """Best score of each cell at least as long as the needle: windows slide over the cell."""
        n = self.size
        lengths = np.array([len(c) for c in cells])
        best = np.zeros(len(cells))
        gap = np.zeros(n - 1, dtype=np.uint32)
        pieces, real = [gap], [np.zeros(n - 1, dtype=np.int64)]
        for c in cells:          # gaps make the end windows: padding never matches
            pieces += [c, gap]
            real += [np.ones(len(c), dtype=np.int64), np.zeros(n - 1, dtype=np.int64)]
        masks = self.masks(np.concatenate(pieces))
        real = np.concatenate(real)
        masks[real == 0] = 0
        covered = np.concatenate([[0], np.cumsum(real)])
        firsts = np.concatenate([[0], np.cumsum(lengths + n - 1)])
        for lo in range(0, int(firsts[-1]), _BLOCK):
            hi = min(lo + _BLOCK, int(firsts[-1]))
            state = np.full(hi - lo, self.start, dtype=self.dtype)
            for t in range(n):
                state = _advance(state, masks[lo + t:hi + t])
            width = covered[lo + n:hi + n] - covered[lo:hi]
            score = 200.0 * _zeros(state, self._const(self.full)) / (n + width)
            rows = np.searchsorted(firsts, np.arange(lo, hi), side="right") - 1
            np.maximum.at(best, rows, score)
        return best

    def over_needle(self, cells: list[np.ndarray], m: int) -> np.ndarray:
        """Best score of cells of one length m, at most the needle's: windows slide over it."""
        masks = self.masks(np.concatenate(cells)).reshape(len(cells), m)
        best = np.zeros(len(cells))
        for first in range(1 - m, self.size):
            lo, hi = max(first, 0), min(first + m, self.size)
            window = self._const(((1 << hi) - 1) ^ ((1 << lo) - 1))
            state = np.full(len(cells), self.start, dtype=self.dtype)
            for t in range(m):
                state = _advance(state, masks[:, t] & window)
            best = np.maximum(best, 200.0 * _zeros(state, window) / (m + hi - lo))
        return best


def _batches(rows: list[int], cells: list[np.ndarray]) -> Iterator[list[int]]:
    """The rows in runs of about `_BATCH` characters, so that long texts do not pile up."""
    run: list[int] = []
    size = 0
    for i in rows:
        run.append(i)
        size += len(cells[i])
        if size >= _BATCH:
            yield run
            run, size = [], 0
    if run:
        yield run


def partial_scores(needle: str, texts: list[str | None]) -> np.ndarray:
    """Scores in 0..100; an empty or missing text scores 0."""
    scores = np.zeros(len(texts))
    needle = needle.lower()
    if not needle:
        return scores
    scorer = _Needle(needle)
    long_rows: list[int] = []
    by_length: dict[int, list[int]] = {}
    cells = [_codes(t.lower()) if isinstance(t, str) else _codes("") for t in texts]
    for i, c in enumerate(cells):
        if len(c) >= scorer.size:
            long_rows.append(i)
        if 0 < len(c) <= scorer.size:
            by_length.setdefault(len(c), []).append(i)
    with np.errstate(over="ignore"):
        for rows in _batches(long_rows, cells):
            scores[rows] = scorer.over_long_cells([cells[i] for i in rows])
        for m, rows in by_length.items():
            found = scorer.over_needle([cells[i] for i in rows], m)
            scores[rows] = np.maximum(scores[rows], found)
    return scores


def _scorer(needle: str) -> Callable:
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(partial_scores(needle, texts.tolist()))

    return score


def can_reach(c: Column, needle: str) -> Column:
    """Cheap JVM-side test that never rejects a cell scoring above 70.

    2*LCS/(n+w) > 0.7 with LCS <= w needs LCS > 0.35*(n + w) and w > 0.7n/1.3, that is more than
    0.538n shared characters; a cell with fewer characters out of the needle's alphabet cannot match.
    """
    low = F.lower(c)
    alphabet = "".join(dict.fromkeys(needle.lower()))
    shared = F.length(low) - F.length(F.translate(low, alphabet, ""))
    return shared > F.least(F.length(low), F.lit(len(needle.lower()))) * F.lit(0.538)


def fuzzy_score(c: Column, needle: str) -> Column:
    """Partial similarity of each cell to the needle; null for a missing cell."""
    return F.when(c.isNotNull(), _scorer(needle)(c))


def fuzzy_match(c: Column, needle: str) -> Column:
    """True where the similarity is strictly above 70; missing and empty cells never match.

    Needles of more than 64 characters are scored with Python integers: the same scores, slower.

    Cells the cheap test rejects cross to Python as null, which scores 0.
    """
    candidate = F.when(can_reach(c, needle), c)
    return F.coalesce(_scorer(needle)(candidate) > fields.FUZZY_ABOVE, F.lit(False))
