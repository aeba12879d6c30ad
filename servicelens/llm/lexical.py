"""Ranked lexical search in reverse: the items are indexed, and the documents stream through.

The items' terms become an inverted index, term to (item, occurrences), which every task gets. One pass
over the documents counts them, their terms and the document frequency of the index's terms. A second
pass takes the term counts of each document through the index, adds up the score of each item that it
meets, and keeps a heap of the best `k` documents per item. A task returns its heaps only, at most `k`
rows an item, and the heaps are merged per item.

The index is broadcast, so its size is bounded: items go in blocks of at most `block_postings` postings,
dealt by hash; more items mean more blocks and passes, not a larger broadcast. Only an item that exceeds
the bound by itself is a larger block. Nothing else that is gathered grows with the documents.

All but the logarithm is integer arithmetic, so scores are alike on every layout. Null texts have no
terms; documents without terms and items without terms rank nowhere. Equal scores go by ascending id,
null ids last. A document is a row: repeated rows count and rank one by one, the order among rows of one
id and score being without effect on the result. An item is a pair of id and text: repeated rows
of it are one item, and texts of one id are ranked one by one. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from servicelens.llm.common import alnum_words, key_blocks, only, sliced, term_frequencies

TOP = 10
LENGTH_SHARE = 75                               # percent of the length penalty that follows the length
BLOCK_POSTINGS = 500_000

_NO_ID = (1 << 63) - 1                          # ranks behind all others


class ItemIndex:
    """Inverted index of a block of items: postings of term t are the places `at[t]` to `at[t + 1]`."""

    def __init__(self, postings: list[Row]) -> None:
        self.items = sorted({(r.item_key, r.item_id) for r in postings}, key=lambda x: x[0])
        numbers = {key: n for n, (key, _) in enumerate(self.items)}
        ordered = sorted(postings, key=lambda r: (r.term, r.item_key))
        self.terms: dict[bytes, int] = {}
        starts = []
        for place, row in enumerate(ordered):
            if bytes(row.term) not in self.terms:
                self.terms[bytes(row.term)] = len(starts)
                starts.append(place)
        self.at = np.array([*starts, len(ordered)])
        self.item = np.array([numbers[r.item_key] for r in ordered], dtype=np.int64)
        self.times = np.array([r.times for r in ordered], dtype=np.int64)

    def scores(self, terms: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """The score of every item, from the gain of each term that a document holds."""
        total = np.zeros(len(self.items), dtype=np.int64)
        lengths = self.at[terms + 1] - self.at[terms]
        places = np.repeat(self.at[terms] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        np.add.at(total, self.item[places], np.repeat(gains, lengths) * self.times[places])
        return total


def term_weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                     for df in frequencies.tolist()], dtype=np.int64)


def term_gains(weights: np.ndarray, times: np.ndarray, length: int, n_docs: int, all_terms: int,
               share: int = LENGTH_SHARE) -> np.ndarray:
    """What each term adds to a score: saturating in its count, less in long documents."""
    norm = 100 - share + (share * length * n_docs) // all_terms
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * norm))


class Heaps:
    """The best `k` (score, id) of every item; the worst of them is known as an array."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.held: list[list[tuple[int, int, bool]]] = [[] for _ in range(items)]
        self.score = np.zeros(items, dtype=np.int64)
        self.id = np.full(items, -(1 << 63), dtype=np.int64)

    def offer(self, doc_id: int | None, scores: np.ndarray) -> None:
        number = _NO_ID if doc_id is None else doc_id
        better = (scores > self.score) | ((scores == self.score) & (number < self.id))
        for item in np.flatnonzero(better & (scores > 0)).tolist():
            held, entry = self.held[item], (int(scores[item]), -number, doc_id is not None)
            if len(held) < self.k:
                heapq.heappush(held, entry)
            else:
                heapq.heapreplace(held, entry)
            if len(held) == self.k:
                self.score[item], self.id[item] = held[0][0], -held[0][1]


def _postings(items: DataFrame) -> DataFrame:
    """(item_key, item_id, term, times) of all items."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for key, item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(alnum_words((text or "").encode()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(found), pa.int64()), pa.array([item_id] * len(found), pa.int64()),
                     pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                    ["item_key", "item_id", "term", "times"])

    rows = only(items, "item_id", "text").select(F.col("item_id").cast("long"), "text").distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item_key"), "item_id", "text").mapInArrow(
        counted, "item_key bigint, item_id bigint, term binary, times bigint")


def _best(rows: DataFrame, index, weights, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the heaps of every task."""
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_term = index.value, weights.value
        heaps = Heaps(len(own.items), k)
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = alnum_words(text or b"")
                counts = Counter(words)
                met = list(own.terms.keys() & counts.keys())
                if met:
                    terms = np.array([own.terms[w] for w in met])
                    times = np.array([counts[w] for w in met], dtype=np.int64)
                    heaps.offer(doc_id, own.scores(
                        terms, term_gains(by_term[terms], times, len(words), n_docs, all_terms)))
        flat = [(item, -number if known else None, score) for item, held in enumerate(heaps.held)
                for score, number, known in held]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)],
                                         ["item", "doc_id", "score"])

    return rows.mapInArrow(searched, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The `k` best documents of each item: item_id, item_key, rank (from 1), doc_id, score.

    `item_key` tells texts of one item id apart.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    results = []
    for block in key_blocks(_postings(items), "item_key", F.lit(1), block_postings):
        own = ItemIndex(block.collect())            # a block is within block_postings
        if not own.items:
            continue
        found, n_docs, all_terms = term_frequencies(rows.select("text"), own.terms)
        if not n_docs:
            continue
        index = spark.sparkContext.broadcast(own)
        weights = spark.sparkContext.broadcast(
            term_weights(n_docs, np.array([found.get(t, 0) for t in range(len(own.terms))])))
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = (_best(rows, index, weights, n_docs, all_terms, k)
                  .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        names = spark.createDataFrame([(n, key, item_id) for n, (key, item_id) in enumerate(own.items)],
                                      "item bigint, item_key bigint, item_id bigint")
        results.append(ranked.join(F.broadcast(names), "item").select("item_id", "item_key", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id bigint, item_key bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.union, results)
