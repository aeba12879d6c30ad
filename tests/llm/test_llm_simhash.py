"""SimHash near-dedup against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from servicelens.llm import simhash
from servicelens.llm.components import components


def slow_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def slow_classes(prints, bits):
    """prints: list of (id, fingerprint); the smallest id reachable for each row."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    return sorted(((d, p, ids.get(find(i))) for i, (d, p) in enumerate(prints)), key=str)


@pytest.mark.parametrize("text", ["", None, "One", "one TWO", "a b c d e f g A B C", "É é Ünï " * 90,
                                  "x\x0by\x1cz w v", " ".join(map(str, range(700)))])
def test_fingerprint(text):
    assert simhash.simhash(text) & (2 ** 64 - 1) == slow_print(text)


def flipped(rng, base, most):
    for bit in rng.choice(64, size=rng.integers(0, most + 1), replace=False):
        base ^= 1 << int(bit)
    return base


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_links_connect_what_all_pairs_connect(spark, bucket_rows):
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 2 ** 63, 12)]
    prints = sorted({flipped(rng, c, 4) for c in centres for _ in range(15)} | {0, 1, 7})
    signed = [p - 2 ** 64 if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    roots = dict(map(tuple, components(simhash.close_links(table, 3, bucket_rows)).collect()))
    groups = {}
    for p in signed:
        groups.setdefault(roots.get(p, p), set()).add(p)
    slow = {}
    for _, p, c in slow_classes([(i, p) for i, p in enumerate(prints)], 3):
        slow.setdefault(c, set()).add(p - 2 ** 64 if p >> 63 else p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_documents(rows):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [(5, base), (2, base), (9, base.replace("word17 ", "other ")), (None, base), (7, None), (8, ""),
             (8, " \n"), (3, "quite another text"), (1, "short"), (1, "short")]
    docs = rows("doc_id bigint, text string, fingerprint string, DOC_ID int",
                *((i, t, "x", 0) for i, t in texts))
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    prints = [(i, slow_print(t)) for i, t in texts]
    assert sorted(((d, p & (2 ** 64 - 1), c) for d, p, c in found), key=str) == slow_classes(prints, 3)


def test_empty_table(rows):
    assert simhash.near_duplicates(rows("doc_id bigint, text string")).count() == 0


def test_chain_is_one_component(rows):
    chain = rows("node bigint, root bigint", *((i + 1, i) for i in range(40)), (100, 90))
    found = dict(map(tuple, components(chain).collect()))
    assert found == {**{i: 0 for i in range(1, 41)}, 100: 90}
