"""Line dedup and fill-in-the-middle against direct versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servicelens.llm import fill_middle, line_dedup
from servicelens.llm.common import word_hashes


# Line dedup

def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def slow_dedup(docs, least_docs, least_chars=1, keep_first=False):
    """Per row: lines, dropped lines, kept text."""
    split = [(t or "").split("\n") for _, t in docs]
    found = Counter(k for lines in split for k in {key(x) for x in lines})
    gone = {k for k, n in found.items() if n >= least_docs and len(k) >= least_chars}
    firsts = {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    for row in order if keep_first else ():
        for i, line in enumerate(split[row]):
            firsts.setdefault(key(line), (docs[row], i))
    result = []
    for row, lines in zip(docs, split):
        kept = [x for i, x in enumerate(lines) if key(x) not in gone or firsts.get(key(x)) == (row, i)]
        result.append((row[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result, key=str)


DOCS = [
    (1, "Header\nown one\n  FOOTER\t\nheader"), (2, "header\n\nown two\nfooter"), (3, "HEADER \r\nown three\nÄ\né"),
    (4, None), (5, ""), (6, "\n\n"), (7, "ä\nfooter"), (8, "é\n" + "long line " * 3000 + "\nä"), (9, "Header\nx "),
    (9, "Header\nx "), (None, "footer\nno id"), (None, "footer\nno id, other"), (12, " \t\nHeader"),
]


@pytest.mark.parametrize("broadcast", [200_000, 0])
@pytest.mark.parametrize("least,chars,first", [(2, 1, False), (3, 1, False), (3, 6, False), (2, 1, True), (3, 1, True)])
def test_line_dedup(rows, broadcast, least, chars, first):
    docs = rows("doc_id bigint, text string, kept int, TEXT string, n_lines string",
                *((i, t, 0, "", "") for i, t in DOCS)).repartition(5)
    found = line_dedup.drop_repeated_lines(docs, least, chars, first, broadcast_lines=broadcast)
    assert found.columns == ["doc_id", "text", "TEXT", "n_lines", "n_dropped", "kept"]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()), key=str)
    assert got == slow_dedup(DOCS, least, chars, first)


def test_line_dedup_with_a_full_filter(rows):
    """One word of 64 bits for all lines: everything is suspected, and the result is the same."""
    docs = [(i, f"line {i}\nshared {i % 7}\nline {i // 2}") for i in range(60)]
    found = line_dedup.drop_repeated_lines(rows("doc_id bigint, text string", *docs), 5, most_bits=64)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect()), key=str) == slow_dedup(docs, 5)


def test_line_dedup_empty_table(rows):
    assert line_dedup.drop_repeated_lines(rows("doc_id bigint, text string")).count() == 0


def test_hot_line_in_slices(rows):
    """One line in every row, more rows than a slice takes."""
    docs = [(i % 3, f"hot\nown {i}") for i in range(400)]
    found = line_dedup.drop_repeated_lines(rows("doc_id bigint, text string", *docs), broadcast_lines=0)
    assert sorted((r.doc_id, r.kept) for r in found.collect()) == sorted((i, t[4:]) for i, t in docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=30), min_size=1, max_size=5), st.sampled_from([1, 3, 50]))
def test_filters_miss_nothing(tasks, words):
    """Whatever is added twice, in one task or in two, the merged second filter holds."""
    whole = line_dedup.SeenTwice(words)
    for task in tasks:
        own = line_dedup.SeenTwice(words)
        for part in (task[:9], task[9:]):
            own.add(word_hashes([b"%d" % x for x in part]))
        at = np.flatnonzero(own.once)
        whole.merge(at, own.once[at], own.twice[at])
    twice = [b"%d" % x for x, n in Counter(x for t in tasks for x in t).items() if n > 1]
    assert line_dedup.known(whole.twice, word_hashes(twice)).all()


def test_few_lines_are_suspected_wrongly():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 64, 40_000, dtype=np.uint64)
    words = len(hashes) * line_dedup.BITS_PER_LINE // 64
    whole = line_dedup.SeenTwice(words)
    for part in np.split(hashes, 8):
        own = line_dedup.SeenTwice(words)
        own.add(part)
        at = np.flatnonzero(own.once)
        whole.merge(at, own.once[at], own.twice[at])
    assert line_dedup.known(whole.twice, hashes).mean() < 0.03


# Fill in the middle

def slow_cut(text, h1, h2):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    return "".join(units[:a]), "".join(units[a:b]), "".join(units[b:]), len(units)


TEXT = st.text(st.sampled_from(list("ab\n\n\n\té€𝄞\x8aਊ")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(0, 1 << 32), st.integers(0, 1 << 32)), min_size=1, max_size=6),
       st.integers(0, 2))
def test_cuts(cases, skip):
    skip = min(skip, len(cases) - 1)
    data, words, bounds = fill_middle.as_words(pa.array([c[0] for c in cases]).slice(skip))
    cases = cases[skip:]
    found = fill_middle.cuts(words, bounds, *(np.array([c[i] for c in cases]) for i in (1, 2)))
    for (text, h1, h2), x, y, n, a, b, before, between in zip(cases, bounds, bounds[1:], *found):
        prefix, middle, suffix, units = slow_cut(text, h1, h2)
        assert (n, before, between) == (units, len(prefix), len(middle))
        assert [data[x:a].decode(), data[a:b].decode(), data[b:y].decode()] == [prefix, middle, suffix]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=8), min_size=1, max_size=4))
def test_marks(parts):
    data = b"".join(parts)
    words = np.frombuffer(data + bytes(8), dtype="<u8")
    for marks, test in ((fill_middle.line_ends(words), lambda b: b == 10),
                        (fill_middle.point_begins(words), lambda b: b & 0xC0 != 0x80)):
        at = [i for i, b in enumerate(data) if test(b)]
        index = fill_middle.Marks(marks)
        offsets = np.arange(len(data) + 1)
        assert index.rank(offsets).tolist() == [sum(i < o for i in at) for o in offsets.tolist()]
        if at:
            assert index.select(np.arange(1, len(at) + 1)).tolist() == [i + 1 for i in at]


FIM_DOCS = [(1, "one\ntwo\nthree"), (2, None), (3, ""), (4, "\n"), (5, "a <P> b\nc"), (6, "x" * 9), (7, "ä\n\n€𝄞\n" * 5000),
            (7, "ä\n\n€𝄞\n" * 5000), (None, "no\nid"), (9, "ends with <\n<S\n<M"), (10, "P>\nS>\nM>\n<")]


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 50}, {"spm_rate": 0}, {"spm_rate": 100},
                                     {"markers": ("[pre]", "[suf]", "[mid]")}])
def test_fill_in_middle(rows, options):
    docs = rows("doc_id bigint, text string, form int, Text string", *((i, t, 0, "q") for i, t in FIM_DOCS))
    made = fill_middle.fill_in_middle(docs, **options)
    assert made.columns == ["doc_id", "text", "Text", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    markers = options.get("markers", fill_middle.MARKERS)
    back = made.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), markers)).collect()
    assert len(back) == len(FIM_DOCS)
    p, s, m = markers
    for row in back:
        text = row.text or ""
        digest = hashlib.sha256(f"{options.get('seed', 7)}:{'null' if row.doc_id is None else row.doc_id}".encode()).hexdigest()
        h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
        prefix, middle, suffix, units = slow_cut(text, *h[:2])
        plain = not text or any(x in text for x in markers) or h[2] % 100 >= options.get("rate", 100)
        form = "plain" if plain else "spm" if h[3] % 100 < options.get("spm_rate", 50) else "psm"
        output = {"plain": text, "psm": f"{p}{prefix}{s}{suffix}{m}{middle}",
                  "spm": f"{s}{suffix}{p}{prefix}{m}{middle}"}[form]
        assert (row.n_units, row.form, row.output, row.back) == (units, form, output, text)
        assert (row.prefix_chars, row.middle_chars) == ((None, None) if plain else (len(prefix), len(middle)))


def test_fill_in_middle_empty_table(rows):
    assert fill_middle.fill_in_middle(rows("doc_id bigint, text string")).count() == 0


def test_markers_must_be_told_apart():
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "<P>>", "<M>"), ("ab", "ba", "c"), ("", "b", "c"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.restore(F.lit(""), F.lit("psm"), markers)
