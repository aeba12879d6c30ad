"""Near duplicates by SimHash: pigeonhole blocks find close fingerprints, Hamming distance decides.

A fingerprint is cut into `max_bits + 3` blocks. Two fingerprints that differ in at most `max_bits`
bits agree in at least three whole blocks, so they meet in the bucket of those blocks. Only distinct
fingerprints are joined: any number of equal texts is one row here.

A bucket yields a spanning forest of its verified links, never its pairs, and is small by
construction: buckets over `bucket_rows` are not gathered at all. Their fingerprints are cut again
into 16 blocks of 4 bits and meet where all but `max_bits` blocks agree. With three bits such a
bucket leaves 12 bits free and cannot hold more than 4096 distinct fingerprints.

Nulls and special cases: a null text is an empty one. Texts without words have fingerprint zero and
are linked like any other. A null id takes part in linking; it is never a component id unless all
ids reachable are null. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.llm.common import durable, only, text_key
from servicelens.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42


def simhash(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint: the majority of each bit over the XXH64 of all word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    spans = zip(starts, ends[shingle - 1:]) if len(words) >= shingle else [(0, len(joined))]
    hashed = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans],
                      dtype="<u8")
    bits = np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), 255):         # sums of at most 255 fit a byte, which is fast
        ones += bits[at:at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(bits), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, keyed: bool = False) -> DataFrame:
    """(doc_id, fingerprint) with the fingerprint as a long; `keyed` adds text_key."""

    @F.pandas_udf(T.LongType())
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    key = [text_key().alias("text_key")] if keyed else []
    return only(docs, "doc_id", "text").select("doc_id", printed("text").alias("fingerprint"), *key)


def block_masks(blocks: int, free: int) -> list[int]:
    """Signed masks that keep all but `free` of the blocks, one for each choice."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(kept) for kept in combinations(whole, blocks - free)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    listed = F.array(*(F.lit(m) for m in masks))
    keys = F.transform(listed, lambda m: F.col("fingerprint").bitwiseAND(m))
    return prints.select("fingerprint", F.posexplode(keys).alias("choice", "key"))


def forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(print, smallest print reached) over verified links, for all but the smallest of each."""
    left, links = np.unique(prints), []
    while left.size > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while front.size and left.size:
            near = np.zeros(left.size, dtype=bool)
            for at in range(0, front.size, 256):
                apart = np.bitwise_count((front[at:at + 256, None] ^ left[None, :]).view(np.uint64))
                near |= (apart <= max_bits).any(axis=0)
            front, left = left[near], left[~near]
            links.extend((int(p), int(root)) for p in front)
    return links


def _forests(buckets: DataFrame, max_bits: int) -> DataFrame:
    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            links = [x for prints in frame["prints"]
                     for x in forest(np.asarray(prints, dtype=np.int64), max_bits)]
            yield pd.DataFrame(links, columns=["node", "root"], dtype="int64")

    gathered = (buckets.groupBy("choice", "key").agg(F.collect_list("fingerprint").alias("prints"))
                .where(F.size("prints") > 1).select("prints"))
    return gathered.mapInPandas(linked, "node bigint, root bigint")


def close_links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = 4096) -> DataFrame:
    """(node, root) links that connect all distinct fingerprints at `max_bits` or fewer bits."""
    keyed = _keyed(prints, block_masks(max_bits + 3, max_bits))
    counts = durable(keyed.groupBy("choice", "key").agg(F.count("*").alias("rows"))
                     .where(F.col("rows") > 1))
    shared = keyed.join(counts, ["choice", "key"])
    links = _forests(shared.where(F.col("rows") <= bucket_rows), max_bits)
    if counts.where(F.col("rows") > bucket_rows).isEmpty():
        return links
    crowded = shared.where(F.col("rows") > bucket_rows).select("fingerprint").distinct()
    return links.union(_forests(_keyed(crowded, block_masks(16, max_bits)), max_bits))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    bucket_rows: int = 4096, keyed: bool = False) -> DataFrame:
    """One row per document: doc_id, fingerprint (long) and component_id, the smallest id reached.

    `keyed` adds text_key, which tells rows of one id apart, and root, a fingerprint that names the
    component, as two components can share their smallest id where ids repeat.
    """
    prints = durable(fingerprints(docs, shingle, keyed))
    classes = durable(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    roots = components(close_links(classes.select("fingerprint"), max_bits, bucket_rows))
    placed = classes.join(roots, classes.fingerprint == roots.node, "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))
    named = durable(placed.groupBy("root").agg(F.min("least_id").alias("component_id")))
    more = ["root"] if keyed else []
    member = durable(placed.join(named, "root").select("fingerprint", "component_id", *more))
    return prints.join(member, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", *(["text_key"] if keyed else []), *more)
