"""Fuzzy matches of a column of needles with a column of cells.

Both columns count by their distinct values. The needles go in blocks of at most `block`, each a stated
set that the cells stream past: a task rules out most needles for a whole Arrow batch of cells by one
matrix of shared characters, and scores what is left with the scorer of single needles. Only matches
become rows, so no pair of needle and cell ever does.

Why not keys: at 70 % a match may lack nearly half of the shorter text's characters, so the pieces of a
pigeonhole argument are one or two characters long, and a join by them would be nearly all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions.fuzzy import partial_scores

BLOCK = 1024
_PAIRS = 1 << 20                # counts of shared characters held at a time
_SHARE = 0.538                  # of the shorter text's characters that a match above 70 shares at least


def character_counts(texts: Sequence[str], alphabet: dict[str, int]) -> np.ndarray:
    """Per text how often it holds each character of the alphabet."""
    counts = np.zeros((len(texts), max(len(alphabet), 1)), dtype=np.int32)
    for row, text in zip(counts, texts):
        for c in text:
            if c in alphabet:
                row[alphabet[c]] += 1
    return counts


def shared_characters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all pairs of rows the sum of the smaller counts, which bounds a common subsequence."""
    shared = np.zeros((len(a), len(b)), dtype=np.int32)
    for column in range(a.shape[1]):
        shared += np.minimum(a[:, column, None], b[None, :, column])
    return shared


def _matches(needles: list[str], above: float) -> Callable:
    low = [n.lower() for n in needles]
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(low))))}
    counts = character_counts(low, alphabet)
    sizes = np.array([len(n) for n in low])

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, _PAIRS // max(len(needles), 1))
        for frame in frames:
            for at in range(0, len(frame), step):
                cells = frame["cell"].iloc[at:at + step].tolist()
                lower = [c.lower() for c in cells]
                shared = shared_characters(character_counts(lower, alphabet), counts)
                shorter = np.minimum(np.array([len(c) for c in lower])[:, None], sizes[None, :])
                close = shared > _SHARE * shorter
                rows = []
                for n in np.flatnonzero(close.any(axis=0)).tolist():
                    chosen = np.flatnonzero(close[:, n])
                    scores = partial_scores(needles[n], [cells[i] for i in chosen])
                    rows += [(needles[n], cells[i], s) for i, s in zip(chosen.tolist(), scores.tolist()) if s > above]
                yield pd.DataFrame(rows, columns=["needle", "cell", "score"])

    return found


def fuzzy_pairs(cells: DataFrame, cell: Column, needles: DataFrame, needle: Column, block: int = BLOCK,
                above: float = fields.FUZZY_ABOVE) -> DataFrame:
    """(needle, cell, score) of the distinct values that score above the limit, 70 or more.

    Missing and empty texts match nothing.
    """
    if above < fields.FUZZY_ABOVE:
        raise ValueError(f"scores of {fields.FUZZY_ABOVE} or less are not looked for")
    values = cells.select(cell.cast("string").alias("cell")).filter("cell <> ''").distinct()
    asked = needles.select(needle.cast("string").alias("needle")).filter("needle <> ''").distinct()
    blocks = max(1, -(-asked.count() // block))
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("needle"), F.lit(blocks)))
    parts = []
    for n in range(blocks):
        listed = dealt.filter(F.col("_block") == n).agg(F.sort_array(F.collect_list("needle"))).first()[0]
        parts.append(values.mapInPandas(_matches(listed, above), "needle string, cell string, score double"))
    return reduce(DataFrame.unionAll, parts)


def fuzzy_join(rows: DataFrame, column: str, needles: DataFrame, needle: str, **options: float) -> DataFrame:
    """The rows with a `needle` that their column is similar to, and the score; a row appears once for
    each of them."""
    pairs = fuzzy_pairs(rows, F.col(column), needles, F.col(needle), **options)
    return rows.join(pairs.withColumnRenamed("cell", "_cell"), F.col(column).cast("string") == F.col("_cell")).drop("_cell")
