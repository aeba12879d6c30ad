"""Best-fit packing against the tokenizer itself and exhaustive search."""

import itertools
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from servicelens.llm import packing
from servicelens.llm.queries import tokenizer_path

TEXTS = ["One small text.", None, "", "Ünïcödé, don't stop: 1,234 <|endoftext|>\n\tx\x1cy", "word " * 300,
         "One small text.", "ΣΑΣ İx ªº é", "!!! ??"]


def expected(texts, capacity):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = []
    for doc_id, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at:at + capacity]
            pieces.append((doc_id, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return sorted(pieces)


def check_layout(rows, capacity):
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)),
                                      key=lambda r: r.sequence_id):
        at = 0
        for row in group:
            assert row.offset == at
            at += row.length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_pieces_and_layout(rows, capacity):
    docs = rows("doc_id bigint, text string, DOC_ID string, room int",
                *((i, t, "x", 1) for i, t in enumerate(TEXTS)))
    packed = packing.pack(docs, tokenizer_path(), capacity).withColumn("crc", F.crc32("ids")).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.crc) for r in packed) == expected(TEXTS, capacity)
    check_layout(packed, capacity)


def test_loose_ends_of_partitions_are_packed_again(rows):
    docs = rows("doc_id bigint, text string", *((i, "a b c d e f g") for i in range(32))).repartition(8)
    packed = packing.pack(docs, tokenizer_path(), 64).collect()
    check_layout(packed, 64)
    assert len({r.sequence_id for r in packed}) == 4        # 32 pieces of 8 ids, 8 to a sequence


def test_empty_table(rows):
    assert packing.pack(rows("doc_id bigint, text string"), tokenizer_path()).count() == 0


def fewest(lengths, capacity):
    """Exhaustive: the least number of bins."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_search_finds_the_fewest_bins(lengths):
    bins = packing.complete(lengths, 20)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    assert all(sum(b) <= 20 for b in bins)
    assert len(bins) == fewest(sorted(lengths, reverse=True), 20)


FREE = packing.Search(*[math.inf] * 4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_search_without_bounds_and_the_lower_bound(lengths):
    bins = packing.complete(lengths, 20, FREE)
    assert sorted(x for b in bins for x in b) == sorted(lengths)
    least = fewest(sorted(lengths, reverse=True), 20)
    assert len(bins) == least >= packing.least_bins(lengths, 20) >= -(-sum(lengths) // 20)


def test_lower_bound_counts_what_cannot_meet():
    assert packing.least_bins([11] * 7, 20) == 7 and packing.least_bins([], 20) == 0
    assert packing.least_bins([12, 12, 12, 9, 9], 20) == 4 and packing.least_bins([10] * 5, 20) == 3
    hard = [2100] * 5000                                    # two never fit: the bound is met without a search
    assert len(packing.complete(hard, 4096, packing.Search(nodes=0))) == 5000 == packing.least_bins(hard, 4096)


def test_search_beats_best_fit():
    lengths = [6, 5, 4, 3, 2]                   # 6 4 | 5 3 2
    worse = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert len(packing.complete(lengths, 10)) == 2
    assert len(packing.best_fit(sorted(worse, reverse=True), 61)) == 4
    assert len(packing.complete(worse, 61)) == 3


def test_without_search_the_incumbent_stands():
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert sorted(x for b in packing.complete(lengths, 61, packing.Search(nodes=1)) for x in b) == sorted(lengths)


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 2)
    encoder = packing._Encoder(tokenizer_path())
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for text in ("a b c d", "c d e", "x a b", "a"):
        found = np.frombuffer(encoder.texts([text], 1)[0], "<u4").tolist()
        assert found == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_ids_of_random_strings():
    """Letters of many kinds, marks, digits and blanks in any order, as the tokenizer itself has them."""
    rng = np.random.default_rng(11)
    signs = [*"abzABZ \n.,!?'-1", "İ", "ı", "ß", "Σ", "ς", "é", "E\u0301", "\u0307", "Ǆ", "ŉ", "ñ", "ﬁ", "ª", "я", "字", "\u00a0", "\u200b",
             "𝄞", "don't", "the", "<|endoftext|>", "ͅ", "Å"]
    texts = ["".join(signs[i] for i in rng.integers(len(signs), size=rng.integers(1, 9))) for _ in range(30_000)]
    found = packing.token_bytes(texts, tokenizer_path())
    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = tokenizer.encode_batch(texts, add_special_tokens=False)
    wrong = [t for t, f, w in zip(texts, found, wanted) if np.frombuffer(f, "<u4").tolist() != [*w.ids, 1]]
    assert wrong == []
