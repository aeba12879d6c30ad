"""A stored substring index: character grams of searched texts, with the rows that hold them.

A gram is two characters where either is beyond ASCII, which suits Japanese, and three ASCII
characters elsewhere. Whether a stretch is a gram depends on its own characters only, so every gram of
a needle is a gram of each text that contains the needle. A search reads the rows of the needle's
rarest grams, intersects them, and leaves the decision to the predicate that a scan would use: the
index narrows a table and never changes a result. Needles without a gram are searched by the scan.

Texts are lower-cased as the predicates do it; a final sigma counts as any other, since its form
depends on what follows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.functions.batches import sliced
from servicelens.session import ensure_checkpoint_dir

ASCII_GRAM = 3
RAREST = 4                      # grams of a needle whose rows are read
LISTED = 2_000_000              # postings gathered in a task before they are written as lists
_BROADCAST_ROWS = 1_000_000
_SLICES = 16                    # parts of a gram's lists, so that a gram of all rows is not one task
_SLICE_BYTES = 1_000_000
_PLACE_BITS = 15                # of a posting's key: the row's place among the gathered ones
_CHUNKS_BITS = 20               # of a chunk's number: chunks of a task
_STEP = 1 << 12                 # rows whose grams are found at a time
_CHARACTER_BITS = 21


def text_grams(text: str) -> set[str]:
    """The grams of a folded text."""
    pieces = {text[i:i + ASCII_GRAM] for i in range(len(text) - ASCII_GRAM + 1)}
    if text.isascii():
        return pieces
    pairs = {text[i:i + 2] for i in range(len(text) - 1)}
    return {p for p in pieces if p.isascii()} | {p for p in pairs if not p.isascii()}


def folded(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))


def like_pieces(query: str) -> list[str]:
    """The literal stretches of a LIKE argument, between its wildcards."""
    return [p for p in re.split("[%_]", query) if p]


def gram_codes(cells: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code, place of the cell) of the grams of :func:`text_grams`, repeats included."""
    texts = [c or "" for c in cells]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    place = np.repeat(np.arange(len(texts)), lengths)
    first, second = chars[:-1], chars[1:]
    pairs = np.flatnonzero(((first | second) > 127) & (place[:-1] == place[1:]))
    ascii_only = (chars[:-2] | chars[1:-1] | chars[2:]) <= 127
    triples = np.flatnonzero(ascii_only & (place[:-2] == place[2:]))
    mark = 1 << (2 * _CHARACTER_BITS)
    codes = [chars[triples] << 14 | chars[triples + 1] << 7 | chars[triples + 2],
             mark | chars[pairs] << _CHARACTER_BITS | chars[pairs + 1]]
    return np.concatenate(codes), place[np.concatenate([triples, pairs])]


def gram_of(code: int) -> str:
    if code >> (2 * _CHARACTER_BITS):
        low = (1 << _CHARACTER_BITS) - 1
        return chr(code >> _CHARACTER_BITS & low) + chr(code & low)
    return chr(code >> 14) + chr(code >> 7 & 127) + chr(code & 127)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.diff(ordered, prepend=-1))


def places_of(gaps: pa.ListArray) -> np.ndarray:
    """The places in lists of gaps, which begin with a place, one list after the other."""
    lengths, steps = pc.list_value_length(gaps).to_numpy(), gaps.flatten().to_numpy().astype(np.int64)
    ends = np.cumsum(steps)
    firsts = (np.cumsum(lengths) - lengths)[lengths > 0]
    return ends - np.repeat(ends[firsts] - steps[firsts], lengths[lengths > 0])


@dataclass
class SubstringIndex:
    """Lists (gram, chunk, rows, ids) and frequencies (gram, rows).

    A gram has a list in each chunk that holds it: the first row's place there, and the gaps to the others. A
    further row of a chunk has the ids of its rows; in place of a gram stands a longer text. Both have to come
    from the same chunks, so an index that is used before it is written is written first, to a folder of its own
    beside the reliable checkpoints.
    """

    lists: DataFrame
    frequencies: DataFrame
    stored: bool = False

    @property
    def postings(self) -> DataFrame:
        """(gram, row), one row per posting."""
        self._store()
        each = _placed(self.lists.filter("ids is null")).select("gram", "chunk", F.explode("places").alias("place"))
        return each.join(self._ids(), "chunk").select("gram", F.get("ids", "place").alias("row"))

    def _ids(self) -> DataFrame:
        return self.lists.filter("ids is not null").select("chunk", "ids")

    def _store(self) -> None:
        if not self.stored:
            self.write(f"{ensure_checkpoint_dir(self.lists.sparkSession).rstrip('/')}/gram-index-{uuid.uuid4().hex}")

    def write(self, path: str) -> None:
        """Store the index, each file in gram order, so that a search reads its grams only."""
        spark, part = self.lists.sparkSession, F.pmod(F.xxhash64("chunk"), F.lit(_SLICES))
        (self.lists.repartition("gram", part).sortWithinPartitions("gram")
         .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lists"))
        (gram_frequencies(spark.read.parquet(f"{path}/lists")).repartitionByRange("gram").sortWithinPartitions("gram")
         .write.mode("overwrite").parquet(f"{path}/frequencies"))
        read = self.read(spark, path)
        self.lists, self.frequencies, self.stored = read.lists, read.frequencies, True

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SubstringIndex:
        return cls(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/frequencies"), True)

    def _rarest(self, pieces: Sequence[str], rarest: int) -> tuple[list[str], int] | None:
        """The rarest grams of the pieces, none where no row has all of them, and how many rows have the
        first; None where no piece has a gram."""
        spark = self.lists.sparkSession
        low = spark.range(1).select(F.array(*(folded(F.lit(p)) for p in pieces)).cast("array<string>")).first()[0]
        grams = sorted(set().union(*map(text_grams, low)))
        if not grams:
            return None
        found = self.frequencies.filter(F.col("gram").isin(grams)).agg(
            F.count("*").alias("known"),
            F.slice(F.array_sort(F.collect_list(F.struct("rows", "gram"))), 1, rarest).alias("rarest")).first()
        if found["known"] < len(grams):
            return [], 0
        return [r["gram"] for r in found["rarest"]], found["rarest"][0]["rows"]

    def _holding(self, chosen: Sequence[str]) -> DataFrame:
        self._store()
        found = _placed(self.lists.filter(F.col("gram").isin(list(chosen)))).groupBy("chunk").agg(
            F.collect_list("places").alias("lists")).filter(F.size("lists") == len(chosen))
        common = F.reduce("lists", F.get("lists", F.lit(0)), F.array_intersect)
        return found.select("chunk", common.alias("places")).join(self._ids().hint("shuffle_hash"), "chunk").select(
            F.explode(F.transform("places", lambda at: F.get("ids", at))).alias("row"))

    def holding(self, pieces: Sequence[str], rarest: int = RAREST) -> DataFrame | None:
        """(row) of the rows that can hold all the pieces; None where no piece has a gram.

        One look at the frequencies chooses the rarest grams; a gram that no row has empties the result.
        """
        found = self._rarest(pieces, rarest)
        return found and self._holding(found[0])

    def narrowed(self, table: DataFrame, needles: Iterable[Sequence[str]], row_id: str = "id") -> DataFrame:
        """The rows of the table that can hold all pieces of one of the needles.

        The frequencies bound the rows found. Where these are few, the table is filtered in place; else
        they are the built side of a hash join, so that long texts are never sorted.
        """
        found = [self._rarest(pieces, RAREST) for pieces in needles]
        if not found or any(f is None for f in found):
            return table
        rows = reduce(DataFrame.unionAll, [self._holding(chosen) for chosen, _ in found])
        few = sum(most for _, most in found) <= _BROADCAST_ROWS
        rows = rows.hint("broadcast" if few else "shuffle_hash")
        return table.join(rows, table[row_id] == rows["row"], "left_semi")


def _placed(lists: DataFrame) -> DataFrame:
    """(gram, chunk, places) of lists of gaps."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            gaps = batch.column("rows")
            ends = np.cumsum(np.append(0, pc.list_value_length(gaps).to_numpy()))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places_of(gaps), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("chunk"), places],
                                             ["gram", "chunk", "places"])

    return lists.select("gram", "chunk", "rows").mapInArrow(placed, "gram string, chunk long, places array<int>")


def gram_frequencies(lists: DataFrame) -> DataFrame:
    return lists.filter("ids is null").groupBy("gram").agg(F.sum(F.size("rows")).alias("rows"))


def build_grams(table: DataFrame, columns: Sequence[str], row_id: str = "id") -> SubstringIndex:
    """The index of the columns of a table with unique row ids, not computed yet; `write` does that.

    A task finds the grams of its rows in Arrow batches, each once a row, and gathers up to `LISTED`
    postings as a chunk, by gram, into lists; so what is shuffled are lists of small numbers. A null cell has no
    grams. A task that is run again after a failure has to meet its rows in the same order, as it does in files.
    """
    schema = T.StructType([
        T.StructField("gram", T.StringType()), T.StructField("chunk", T.LongType()),
        T.StructField("rows", T.ArrayType(T.ShortType())),
        T.StructField("ids", T.ArrayType(table.schema[row_id].dataType))])

    def lists(chunk: int, keys: list[np.ndarray], ids: list[pa.Array]) -> pa.RecordBatch:
        every, rows = np.sort(np.concatenate(keys)), pa.concat_arrays(ids)
        codes, places = every >> _PLACE_BITS, (every & ((1 << _PLACE_BITS) - 1)).astype(np.int16)
        starts = _starts(codes)
        gaps = np.diff(places, prepend=np.int16(0))
        gaps[starts] = places[starts]
        grams = pa.array([f"chunk {chunk}", *(gram_of(c) for c in codes[starts].tolist())], pa.string())
        ends = pa.array(np.concatenate([[0], starts, [len(codes)]]), pa.int32())
        own = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays(
            [grams, pa.array(np.full(len(grams), chunk)), pa.ListArray.from_arrays(ends, pa.array(gaps)),
             pa.concat_arrays([own, pa.nulls(len(starts), own.type)])], schema.fieldNames())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, keys, ids, postings, places = TaskContext.get().partitionId() << _CHUNKS_BITS, [], [], 0, 0
        for some in sliced(batches, _SLICE_BYTES):
            for at in range(0, some.num_rows, _STEP):
                batch = some.slice(at, _STEP)
                if postings >= LISTED or places + batch.num_rows > 1 << _PLACE_BITS:
                    yield lists(chunk, keys, ids)
                    chunk, keys, ids, postings, places = chunk + 1, [], [], 0, 0
                found = [code << _PLACE_BITS | places + place for code, place in (
                    gram_codes(batch.column(i).to_pylist()) for i in range(1, batch.num_columns))]
                held = np.sort(np.concatenate(found))
                keys.append(held[_starts(held)])
                ids.append(batch.column(0))
                postings, places = postings + len(keys[-1]), places + batch.num_rows
        if keys:
            yield lists(chunk, keys, ids)

    cells = table.select(row_id, *(folded(F.col(c).cast("string")) for c in columns))
    gathered = cells.mapInArrow(listed, schema)
    return SubstringIndex(gathered, gram_frequencies(gathered))
