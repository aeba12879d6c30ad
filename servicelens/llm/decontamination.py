"""Benchmark decontamination: rare-word seeds, then Smith-Waterman alignment.

Every word of a test item is an n-gram of size one, ranked by the number of documents that hold it.
The rarest ones of each item are its seeds, as many as the least score demands. An alignment that
reaches this score leaves only so many of the item's words unmatched, so by the pigeonhole principle a
known number of the seeds must be matched, within a stretch of the text whose length is bounded as well.
Only there the item is aligned word by word, and only if its words can stand there in their order often
enough. So no leak is lost, however it is edited, and words that are common in the documents select
nothing, as long as the item has rarer ones.

The seeds of the items are an inverted index that every task gets, and texts are joined with it where they
lie: the documents are read twice, first for the document frequencies of the items' words, and never
shuffled. The index is bounded: items go in blocks of at most `block_words` words, dealt by hash, and
more items mean more steps within a task. Only an item beyond the bound by itself is a larger block.

The score of an alignment is its share of a perfect one. It must reach `least_score` and be worth
`SHORT` matched words at least, so an item of `SHORT` or fewer words must occur word by word.

Nulls and special cases: null texts are empty; an item without words matches nothing. A document is a
row, so repeated rows give repeated rows. A null item id is an id like any other; repeated rows of an
item are one, and texts of one id are items of their own. Extra columns are kept; `leaks` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.llm.common import alnum_words, key_blocks, only, shielded, sliced, term_frequencies

BLOCK_WORDS = 1_000_000
LEAST_SCORE = 0.5
SHORT = 4
SEED_SHARE = 0.65               # of an item's words; more seeds must be hit more often
MATCH, MISMATCH, GAP = 2, -1, -1

_LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
_LEAKS = "array<struct<item_id:bigint,score:double,start:bigint,end:bigint>>"


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best score, and where it begins and ends in the region.

    One row of the table at a time; gaps along the row are a running maximum.
    """
    width = len(region)
    steps = np.arange(width + 1) * GAP
    above = np.zeros(width + 1, dtype=np.int64)
    begins = np.arange(width + 1)
    best, start, end = 0, 0, 0
    for word in item:
        straight = above[:-1] + np.where(region == word, MATCH, MISMATCH)
        down = above[1:] + GAP
        own = np.maximum(straight, down)
        row = np.concatenate(([0], np.maximum(own, 0)))
        first = np.concatenate(([0], np.where(own <= 0, np.arange(1, width + 1),
                                              np.where(straight >= down, begins[:-1], begins[1:]))))
        level = row - steps
        peak = np.maximum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == peak, np.arange(width + 1), 0))
        above, begins = peak + steps, first[origin]
        top = int(above.argmax())
        if above[top] > best:
            best, start, end = int(above[top]), int(begins[top]), top
    return best, start, end


def _masks(words: list[bytes]) -> dict[bytes, int]:
    """The places of each word as bits."""
    masks: dict[bytes, int] = {}
    for place, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << place
    return masks


class Seeds:
    """The rarest words of a block of items, as an inverted index.

    `need[i]` text words within fewer than `span[i]` words must be seeds of item i. An alignment of m
    matches and e errors scores 2m - e, so a score of x takes m >= x / 2, leaves at most (words - x / 2)
    words of the item unmatched, and covers m + e <= 3 * words - x words of the text.
    """

    def __init__(self, items: Sequence[tuple[int | None, list[bytes]]], frequencies: Mapping[bytes, int],
                 least_score: float = LEAST_SCORE) -> None:
        self.items = [(item_id, words) for item_id, words in items if words]
        self.least = [max(math.ceil(MATCH * least_score * len(w)), MATCH * min(len(w), SHORT)) for _, w in self.items]
        self.masks = [_masks(words) for _, words in self.items]
        by_word: dict[bytes, list[int]] = {}
        need, span = [], []
        for number, ((_, words), least) in enumerate(zip(self.items, self.least)):
            spare = len(words) - -(-least // MATCH)             # words that may be left unmatched
            count = min(len(words), max(spare + 1, math.ceil(SEED_SHARE * len(words))))
            need.append(count - spare)
            span.append(3 * len(words) - least)
            rarest = sorted(range(len(words)), key=lambda i: (frequencies.get(words[i], 0), words[i], i))[:count]
            for word in {words[i] for i in rarest}:
                by_word.setdefault(word, []).append(number)
        self.need, self.span = np.array(need, dtype=np.int64), np.array(span, dtype=np.int64)
        self.words = {word: n for n, word in enumerate(by_word)}
        self.at = np.cumsum([0, *map(len, by_word.values())])
        self.item = np.array([i for of in by_word.values() for i in of], dtype=np.int64)

    def regions(self, words: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """For each item with enough seeds close together the stretches of the text to align."""
        seeds = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        places = np.flatnonzero(seeds >= 0)
        seeds = seeds[places]
        lengths = self.at[seeds + 1] - self.at[seeds]
        index = np.repeat(self.at[seeds] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        items, places = self.item[index], np.repeat(places, lengths)
        order = np.argsort(items, kind="stable")
        items, places = items[order], places[order]
        last = np.arange(len(items)) + self.need[items] - 1
        inside = last < len(items)
        last = np.where(inside, last, 0)
        close = inside & (items[last] == items) & (places[last] - places < self.span[items])
        chosen = np.flatnonzero(close)
        if not len(chosen):
            return {}
        items, last = items[chosen], places[last[chosen]]
        wide = self.span[items]
        begins, ends = np.maximum(last - wide + 1, 0), np.minimum(places[chosen] + wide, len(words))
        heads = np.flatnonzero((np.diff(items, prepend=-1) != 0) | (begins > np.concatenate(([0], ends[:-1]))))
        tails = np.append(heads[1:] - 1, len(items) - 1)
        found: dict[int, list[tuple[int, int]]] = {}
        for item, a, b in zip(items[heads].tolist(), begins[heads].tolist(), ends[tails].tolist()):
            if kept := self._holding(item, words, a, b):
                found.setdefault(item, []).extend(kept)
        return found

    def _holding(self, item: int, words: list[bytes], a: int, b: int) -> list[tuple[int, int]]:
        """The parts of a stretch with enough of the item's words in their order, wherever they stand.

        Every alignment lies in a window of twice its greatest length that begins at a multiple of that
        length. The longest common subsequence of window and item is counted in the bits of one number.
        """
        masks, wide, size = self.masks[item], int(self.span[item]), len(self.items[item][1])
        least, full = -(-self.least[item] // MATCH), (1 << size) - 1
        kept: list[tuple[int, int]] = []
        for at in range(a, max(a + 1, b - wide), wide):
            end = min(b, at + 2 * wide)
            state = full
            for mask in map(masks.get, words[at:end]):
                if mask:
                    hit = state & mask
                    state = ((state + hit) | (state - hit)) & full
            if size - state.bit_count() >= least:
                if kept and at <= kept[-1][1]:
                    kept[-1] = (kept[-1][0], end)
                else:
                    kept.append((at, end))
        return kept

    def leaks(self, text: bytes | None) -> list[dict]:
        """The items that the text holds: id, score and word span of the best alignment, the first of
        equal ones."""
        words = alnum_words(text or b"")
        found = []
        for number, stretches in self.regions(words).items():
            item_id, item = self.items[number]
            codes: dict[bytes, int] = {}
            own = np.array([codes.setdefault(w, len(codes)) for w in item], dtype=np.int64)
            best = max(((*align(own, np.array([codes.get(w, -1) for w in words[a:b]], dtype=np.int64)), a)
                        for a, b in stretches), key=lambda x: (x[0], -x[3]))
            if best[0] >= self.least[number]:
                found.append({"item_id": item_id, "score": best[0] / (MATCH * len(item)),
                              "start": best[3] + best[1], "end": best[3] + best[2]})
        return found


def _in_order(leaks: list[dict]) -> list[dict]:
    return sorted(leaks, key=lambda x: (x["item_id"] is None, x["item_id"], x["start"], x["end"], x["score"]))


def item_seeds(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE,
               block_words: int = BLOCK_WORDS) -> list[Seeds]:
    """The seeds of all items in bounded blocks, ranked by their document frequency in `docs`."""
    items = (only(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), "text").distinct()
             .withColumn("item_key", F.xxhash64("item_id", "text")))
    texts = only(docs, "text")
    blocks = []
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    for block in key_blocks(items, "item_key", words, block_words):
        listed = [(r.item_id, alnum_words((r.text or "").encode())) for r in block.collect()]   # within block_words
        terms = {w: n for n, w in enumerate(dict.fromkeys(w for _, of in listed for w in of))}
        counts, _, _ = term_frequencies(texts, terms)
        blocks.append(Seeds(listed, {w: counts.get(n, 0) for w, n in terms.items()}, least_score))
    return blocks


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep_clean: bool = True,
               least_score: float = LEAST_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with `leaks`: array of (item_id, score, start, end), word spans of the text.

    Without `keep_clean` only documents with a leak are returned.
    """
    safe, restored = shielded(docs, ("text",), ("leaks",))
    context = docs.sparkSession.sparkContext
    judged = safe.withColumn("leaks", F.array().cast(_LEAKS))
    names, schema = judged.columns, T.StructType(judged.schema.fields)

    def looking(seeds) -> Iterator[pa.RecordBatch]:
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                before = batch.column("leaks").to_pylist()
                leaks = [_in_order(old + seeds.value.leaks(text)) for old, text in
                         zip(before, batch.column("text").cast(pa.binary()).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n) for n in names[:-1]), pa.array(leaks, pa.list_(_LEAK))], names)

        return judge

    for block in item_seeds(docs, benchmark, least_score, block_words):
        if block.items:
            judged = judged.mapInArrow(looking(context.broadcast(block)), schema)
    found = restored(judged)
    return found if keep_clean else found.where(F.size("leaks") > 0)
