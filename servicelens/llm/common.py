"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ASCII_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A
    else 0x20 for b in range(256))
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: the one that `spark.checkpoint.dir` names.

    Where the setting is absent, a local session gets a folder of its own; elsewhere that would be
    one machine's disk, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that lost executors cost no recomputation."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, also where other columns differ from them in case only.

    Spark resolves names without regard to case, so `DOC_ID` beside `doc_id` would be ambiguous;
    the columns are picked by position instead.
    """
    taken = df.columns
    safe = df.toDF(*(f"_{i}" for i in range(len(taken))))
    return safe.select(*(F.col(f"_{taken.index(n)}").alias(n) for n in names))


def shielded(df: DataFrame, used: Sequence[str], added: Sequence[str]
             ) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with all columns but the used ones under names of their own, and a way back.

    So a column `TEXT` cannot clash with `text`. The way back selects the columns in their old order
    and then the added ones, which replace columns of the same name.
    """
    first = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    kept = [(i, n) for n, i in sorted(first.items(), key=lambda x: x[1]) if n not in added]
    names = [n if n in used else f"_kept{i}" for i, n in kept]
    safe = df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(
        *(F.col(f"_{i}").alias(n) for (i, _), n in zip(kept, names)))

    def restored(result: DataFrame) -> DataFrame:
        return result.select(*names, *added).toDF(*(n for _, n in kept), *added)

    return safe, restored


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-case words (A-Z only) made of ASCII letters, digits and any character beyond ASCII."""
    return text.translate(_ASCII_WORDS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for every run of `size` words, from the hashes of the words."""
    count = max(0, len(words) - size + 1)
    total = np.full(count, size, dtype=np.uint64)
    for i in range(size):
        total = (total ^ words[i:i + count]) * _MIX[0]
        total = (total ^ (total >> np.uint64(29))) * _MIX[1]
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def rolling_grams(df: DataFrame, sizes: list[int]) -> DataFrame:
    """`text` becomes `n_words` and `grams`: for each size in turn the hashes of all word runs.

    `at` is the index in `grams` where the hashes of each size begin. Null texts have no words.
    Other columns are kept.
    """
    kept = [f for f in df.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        "n_words bigint", "at array<int>", "grams array<bigint>"])
    names = [f.name for f in kept]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts, starts, grams, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = word_hashes(alnum_words((text.as_py() or "").encode()))
                each = [gram_hashes(words, n) for n in sizes]
                counts.append(len(words))
                starts.append(np.cumsum([0, *map(len, each[:-1])]).tolist())
                grams.extend(each)
                ends.append(ends[-1] + sum(map(len, each)))
            flat = np.concatenate(grams) if grams else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(counts, pa.int64()),
                 pa.array(starts, pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                [*names, "n_words", "at", "grams"])

    return df.mapInArrow(hashed, schema)


def sliced(batches: Iterator[pa.RecordBatch], chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few megabytes, so that long texts do not add up in memory."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * chars / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def key_blocks(df: DataFrame, key: str, weight: Column, bound: int) -> list[DataFrame]:
    """The rows in parts by the hash of a key, each weighing at most `bound` or being of one key only."""
    weighed = df.select(F.col(key).alias("key"), weight.alias("weight"))
    count = max(1, -(-(weighed.agg(F.sum("weight")).first()[0] or 0) // bound))
    while True:
        def block(name: str, parts: int = count) -> Column:
            return F.pmod(F.xxhash64(name, F.lit(parts)), F.lit(parts))

        crowded = (weighed.groupBy(block("key").alias("block"))
                   .agg(F.sum("weight").alias("weight"), F.min("key").alias("a"), F.max("key").alias("b"))
                   .where((F.col("a") != F.col("b")) & (F.col("weight") > bound)))
        if crowded.isEmpty():
            return [df.where(block(key) == n) for n in range(count)]
        count *= 2


def term_frequencies(texts: DataFrame, terms: dict[bytes, int]) -> tuple[dict[int, int], int, int]:
    """(rows that hold each of the terms, by its number; rows with a word; words) of the column `text`.

    What comes back is as long as `terms` at most, whatever the texts are.
    """
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        found: Counter[int] = Counter()
        for batch in sliced(batches):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = alnum_words(text or b"")
                found[-1] += bool(words)
                found[-2] += len(words)
                found.update(numbers[w] for w in numbers.keys() & set(words))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                         ["term", "rows"])

    each = texts.mapInArrow(counted, "term bigint, rows bigint")
    found = dict(each.groupBy("term").agg(F.sum("rows")).collect())
    return found, found.pop(-1, 0), found.pop(-2, 0)


def text_key() -> Column:
    """A digest of the text; with the id it tells rows apart where ids repeat."""
    return F.xxhash64(F.coalesce("text", F.lit("")))
