"""Ranked lexical search against a direct version."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from servicelens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_search(docs, items, k=10):
    """(item_id, rank, doc_id, score) for distinct items."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    result = []
    for item_id, text in set(items):
        scores = []
        for doc_id, counts, n in held:
            score = 0
            for term in terms(text):
                df, tf = sum(term in c for _, c, _ in held), counts[term]
                if tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += weight * ((10 ** 9 * tf) // (1000 * tf + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        result += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(result, key=str)


def found(docs, items, **options):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in
                   lexical.search(docs, items, **options).collect()), key=str)


DOCS = [(i, "the cat sat on the mat " * (i % 5 + 1) + f"word{i} {'rare' if i == 17 else ''} É1 é1") for i in range(30)]
DOCS += [(30, None), (31, ""), (32, "... !!"), (None, "the cat"), (None, "the cat"), (3, "the cat"), (3, "the cat"),
         (40, "lone " * 20_000 + "cat")]
ITEMS = [(1, "The CAT, the mat?"), (2, None), (3, ""), (4, "rare rare lone"), (5, "nowhere to be seen"), (6, "é1 É1"),
         (None, "cat"), (7, "word3 word4 word5"), (1, "The CAT, the mat?")]


@pytest.mark.parametrize("options", [{}, {"block_postings": 5}, {"k": 1}, {"k": 100}, {"block_postings": 1, "k": 3}])
def test_search(rows, options):
    docs = rows("doc_id bigint, text string, SCORE int, Doc_Id int", *((*d, 1, 1) for d in DOCS)).repartition(6)
    items = rows("item_id bigint, text string, rank int, TEXT string", *((*i, 1, "") for i in ITEMS))
    assert found(docs, items, **options) == slow_search(DOCS, ITEMS, options.get("k", 10))


def test_two_texts_of_one_item(rows):
    docs = rows("doc_id bigint, text string", (1, "a b"), (2, "c"), (3, "d"))
    result = lexical.search(docs, rows("item_id bigint, text string", (1, "a"), (1, "c"))).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in result) == [(1, 1, 1), (1, 1, 2)]
    assert len({r.item_key for r in result}) == 2


def test_empty_tables(rows):
    some, none = rows("doc_id bigint, text string", (1, "a")), rows("doc_id bigint, text string")
    asked, nothing = rows("item_id bigint, text string", (1, "a")), rows("item_id bigint, text string")
    assert found(none, asked) == [] and found(some, nothing) == [] and found(none, nothing) == []
    assert found(rows("doc_id bigint, text string", (1, None)), asked) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 9)), st.lists(st.integers(0, 3), min_size=3, max_size=3)),
                max_size=25), st.integers(1, 4))
def test_heaps(offers, k):
    heaps = lexical.Heaps(3, k)
    for doc_id, scores in offers:
        heaps.offer(doc_id, np.array(scores))
    for item in range(3):
        wanted = sorted((-s[item], d is None, d) for d, s in offers if s[item] > 0)[:k]
        held = sorted((-score, not known, -number if known else None) for score, number, known in heaps.held[item])
        assert held == wanted
