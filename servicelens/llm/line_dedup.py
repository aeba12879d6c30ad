"""Line dedup by two Bloom filters: hashes seen once and hashes seen twice.

Every task puts the 64-bit hashes of its lines' keys into a filter of its own; a hash that is already
there goes into a second one. The filters of all tasks meet segment by segment: what two of them hold
once is seen twice. So the second filter holds every key that two documents share, and some more.
Only lines that it knows are shuffled, as SHA-256 digests counted map-side, which confirms exactly in
how many documents a key is found. Most lines are never shuffled.

The filters follow the number of lines, `bits_per_line` each, up to `most_bits`. Beyond that they fill
up: more lines are suspected and shuffled, and the result stays exact. A task holds both filters, at
most `most_bits / 4` bytes, and what it sends is in proportion to its lines, not to the filter.

Digests of repeated lines are broadcast while they are at most `broadcast_lines`; beyond, suspected
lines join them by digest, frequent digests in slices, and the texts meet their lists by id.

A key is the line without white space at both ends, A-Z in lower case. A document is a row: repeated
rows count one by one. Null texts are empty, and an empty text is one empty line. Keys of fewer than
`least_chars` code points always stay; so do all lines of a table with fewer than `least_docs` rows. With
`keep_first` the first occurrence by id, text and line number stays; rows equal in id and text share
it, and a null id comes first. Extra columns are returned as they are; `n_lines`, `n_dropped` and `kept`
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.llm.common import durable, only, shielded, sliced, text_key, word_hashes
from servicelens.operators.skew import join_counted_key

LEAST_DOCS = 10
BITS_PER_LINE = 16
MOST_BITS = 1 << 29
BROADCAST_LINES = 200_000

_SPACE = b" \t\n\x0b\x0c\r"
_PROBES = 4
_SEGMENT = 4096                                 # words; a place in a segment fits 16 bits


class SeenTwice:
    """Two Bloom filters of 64-bit words. A hash sets `_PROBES` bits of one word."""

    def __init__(self, words: int) -> None:
        self.once = np.zeros(words, dtype="<u8")
        self.twice = np.zeros(words, dtype="<u8")

    def add(self, hashes: np.ndarray) -> None:
        hashes, times = np.unique(hashes, return_counts=True)
        at, bits = places(hashes, len(self.once))
        again = ((self.once[at] & bits) == bits) | (times > 1)
        _set(self.twice, at[again], bits[again])
        _set(self.once, at, bits)

    def merge(self, at: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
        """Take in the words of another pair; `at` are their distinct places."""
        self.twice[at] |= twice | (self.once[at] & once)
        self.once[at] |= once


def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each hash, by its upper half, and its bits there, by its lower half."""
    at = (hashes >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)
    bits = np.zeros(len(hashes), dtype=np.uint64)
    for i in range(_PROBES):
        bits |= np.uint64(1) << (hashes >> np.uint64(6 * i) & np.uint64(63))
    return at.astype(np.int64), bits


def _set(filled: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Or the bits in; the places are in order and may repeat."""
    if len(at):
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        filled[at[begins]] |= np.bitwise_or.reduceat(bits, begins)


def known(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds; it may name others, but misses none."""
    at, bits = places(hashes, len(filled))
    return (filled[at] & bits) == bits


def line_keys(text: bytes | None) -> list[bytes]:
    return [line.strip(_SPACE) for line in (text or b"").lower().split(b"\n")]


def _long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars)


def _binary(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def seen_twice(texts: DataFrame, words: int, least_chars: int) -> np.ndarray:
    """The filter of all keys that two rows hold, from the column `text`."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SeenTwice(words)
        for batch in sliced(batches):
            keys = [k for text in _binary(batch) for k in set(line_keys(text)) if _long_enough(k, least_chars)]
            own.add(word_hashes(keys))
        filled = np.flatnonzero(own.once)
        for at in np.split(filled, np.flatnonzero(np.diff(filled // _SEGMENT)) + 1):
            if len(at):
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([at[0] // _SEGMENT], pa.int32()),
                    "places": [(at % _SEGMENT).astype("<u2").tobytes()],
                    "once": [own.once[at].tobytes()], "twice": [own.twice[at].tobytes()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, SeenTwice] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["segment"], SeenTwice(_SEGMENT)).merge(
                    np.frombuffer(row["places"], "<u2"), np.frombuffer(row["once"], "<u8"),
                    np.frombuffer(row["twice"], "<u8"))
        for segment, pair in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()),
                                              "twice": [pair.twice.tobytes()]})

    parts = texts.mapInArrow(built, "segment int, places binary, once binary, twice binary")
    found = parts.repartition("segment").mapInArrow(merged, "segment int, twice binary")
    whole = np.zeros(-(-words // _SEGMENT) * _SEGMENT, dtype="<u8")
    for segment, twice in found.collect():       # at most most_bits / 8 bytes in all
        whole[segment * _SEGMENT:(segment + 1) * _SEGMENT] = np.frombuffer(twice, "<u8")
    return whole[:words]


def _suspects(rows: DataFrame, twice: Broadcast, least_chars: int) -> DataFrame:
    """(doc_id, text_key, digest, line) of the suspected keys of each row, by their first line."""
    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("digest", T.BinaryType()), T.StructField("line", T.IntegerType())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, of, lines = [], [], []
            for row, text in enumerate(_binary(batch)):
                firsts: dict[bytes, int] = {}
                for line, key in enumerate(line_keys(text)):
                    firsts.setdefault(key, line)
                for key, line in firsts.items():
                    if _long_enough(key, least_chars):
                        keys.append(key)
                        of.append(row)
                        lines.append(line)
            held = np.flatnonzero(known(twice.value, word_hashes(keys)))
            taken = pa.array(np.asarray(of, dtype=np.int64)[held])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(taken) for f in fields),
                 pa.array([hashlib.sha256(keys[i]).digest() for i in held], pa.binary()),
                 pa.array(np.asarray(lines, dtype=np.int32)[held])], [f.name for f in schema.fields])

    return rows.mapInArrow(named, schema)


def _repeated(suspects: DataFrame, least_docs: int, keep_first: bool) -> DataFrame:
    """(digest, docs, first) of the keys that enough rows hold."""
    first = F.min(F.struct("doc_id", "text_key", "line")) if keep_first else F.lit(None).cast(
        "struct<doc_id:bigint,text_key:bigint,line:int>")
    return (suspects.groupBy("digest").agg(F.count("*").alias("docs"), first.alias("first"))
            .where(F.col("docs") >= least_docs))


def _listed(suspects: DataFrame, repeated: DataFrame) -> DataFrame:
    """(list_id, list_key, marks): per row its repeated keys, with the line to keep or -1."""
    spread = suspects.withColumn("row", F.xxhash64("doc_id", "text_key"))
    joined = join_counted_key(spread, repeated, "digest", "docs", spread_by="row", build_keyed=True)
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    stays = F.when(F.col("first").isNotNull() & own, F.col("first.line")).otherwise(-1)
    return joined.groupBy(F.col("doc_id").alias("list_id"), F.col("text_key").alias("list_key")).agg(
        F.collect_set(F.struct("digest", stays.alias("stays"))).alias("marks"))


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = 1,
                        keep_first: bool = False, bits_per_line: int = BITS_PER_LINE,
                        most_bits: int = MOST_BITS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The documents with `n_lines`, `n_dropped` (long) and `kept`, the text without repeated lines."""
    context = docs.sparkSession.sparkContext
    added = ("n_lines", "n_dropped", "kept")
    safe, restored = shielded(docs, ("doc_id", "text"), added)
    rows = only(docs, "doc_id", "text")
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    lines = rows.agg(F.coalesce(F.sum(F.coalesce(ends, F.lit(0)) + 1), F.lit(0))).first()[0]
    words = max(1, min(lines * bits_per_line, most_bits) // 64)
    twice = context.broadcast(seen_twice(rows.select("text"), words, least_chars))

    identified = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key"))
    suspects = _suspects(identified, twice, least_chars)
    repeated = _repeated(suspects, least_docs, keep_first)
    few = repeated.limit(broadcast_lines + 1).collect()
    keyed = safe.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", text_key())
    if len(few) <= broadcast_lines:
        marks = context.broadcast({bytes(r.digest): tuple(r.first) if r.first else None for r in few})
        joined = keyed
    else:
        marks = None
        lists = _listed(suspects, durable(repeated))
        joined = keyed.join(lists, F.col("_id").eqNullSafe(F.col("list_id"))
                            & (F.col("_key") == F.col("list_key")), "left").drop("list_id", "list_key")
    result = T.StructType([*joined.schema.fields, T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def stays(digest: bytes, line: int, doc_id: int | None, key: int, own: dict[bytes, int] | None) -> bool:
        if own is not None:
            return own.get(digest, line) == line
        first = marks.value.get(digest, False)
        return first is False or first == (doc_id, key, line)

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = _binary(batch)
            keys = [line_keys(t) for t in texts]
            suspected = known(twice.value, word_hashes([k for of in keys for k in of]))
            owners = zip(batch.column("_id").to_pylist(), batch.column("_key").to_pylist(),
                         [None] * len(texts) if marks else batch.column("marks").to_pylist())
            at, counts, gone, kept = 0, [], [], []
            for text, of, (doc_id, key, listed) in zip(texts, keys, owners):
                own = None if marks else {m["digest"]: m["stays"] for m in listed or ()}
                out = {i for i in np.flatnonzero(suspected[at:at + len(of)]).tolist()
                       if _long_enough(of[i], least_chars)
                       and not stays(hashlib.sha256(of[i]).digest(), i, doc_id, key, own)}
                at += len(of)
                counts.append(len(of))
                gone.append(len(out))
                kept.append(b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in out)
                            if out else text or b"")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], [f.name for f in result.fields])

    return restored(joined.mapInArrow(dropped, result))
