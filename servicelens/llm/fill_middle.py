"""Fill-in-the-middle by SWAR words: lines are found in the UTF-8 bytes, eight at a time.

A batch of texts is viewed as 64-bit words. Arithmetic marks each byte that ends a line (0x80 in the
byte, exact, without carries into others), `bitwise_count` counts the marks of each word, and a running
sum over the words is searched for the word that holds the wanted mark; the mark is then picked inside
that word. Code points are counted in the same way, by marks on the bytes that begin one. All rows of a
batch are cut by a few array operations, whatever the length of their texts, and nothing is shuffled.

Lines are `[^\\n]*\\n|[^\\n]+`. Where a text is cut follows from the digest of `seed:doc_id` alone, so
every layout and rerun gives the same result. A null id counts as the word null; a null text is an empty
one. An empty text, one that contains a marker, and one beyond the rate is `plain`: the output is the text,
and the lengths are null. Repeated rows give repeated rows. Extra columns are returned as they are;
`n_units`, `form`, `prefix_chars`, `middle_chars` and `output` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.llm.common import shielded, sliced

SEED = 7
RATE = 100                                      # percent of the texts that are transformed
SPM_RATE = 50                                   # percent of those that put the suffix first
MARKERS = ("<P>", "<S>", "<M>")                 # before prefix, suffix and middle

_EACH = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def line_ends(words: np.ndarray) -> np.ndarray:
    """0x80 in each byte that is a line feed."""
    other = words ^ (_EACH * np.uint64(0x0A))
    return ~(((other & _LOW) + _LOW) | other | _LOW)


def point_begins(words: np.ndarray) -> np.ndarray:
    """0x80 in each byte that begins a code point, that is all but 10xxxxxx."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Marked bytes of a buffer with counts before each word: rank and select for whole arrays."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """Marks before each byte offset, which is less than the buffer's length."""
        word, byte = offsets >> 3, (offsets & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, numbers: np.ndarray) -> np.ndarray:
        """The byte offset behind the mark of each number, from 1."""
        word = np.searchsorted(self.before[1:], numbers)
        left = self.marks[word]
        ahead = numbers - self.before[word] - 1
        for step in range(7):                   # a word holds at most eight marks
            left = np.where(ahead > step, left & (left - np.uint64(1)), left)
        lowest = left & (~left + np.uint64(1))
        return 8 * word + (np.bitwise_count(lowest - np.uint64(1)) >> 3) + 1


def as_words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, 64-bit words, bounds) of an Arrow array of texts; null texts are empty."""
    stored = texts.cast(pa.large_binary())
    bounds = np.frombuffer(stored.buffers()[1], dtype=np.int64)[stored.offset:stored.offset + len(stored) + 1]
    data = stored.buffers()[2]
    size = int(bounds[-1] - bounds[0])
    words = np.zeros(size // 8 + 1, dtype="<u8")
    if size:
        words.view(np.uint8)[:size] = np.frombuffer(data, dtype=np.uint8)[bounds[0]:bounds[-1]]
    return words.view(np.uint8)[:size].tobytes(), words, bounds - bounds[0]


def cuts(words: np.ndarray, bounds: np.ndarray, first: np.ndarray, second: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: lines, ends of prefix and middle in bytes, and both lengths in code points.

    `first` and `second` are the two numbers that choose among the `lines + 1` places to cut.
    """
    begin, end = bounds[:-1], bounds[1:]
    ends, points = Marks(line_ends(words)), Marks(point_begins(words))
    before = ends.rank(begin)
    closed = ends.rank(end) - before
    last = words.view(np.uint8)[np.maximum(end - 1, 0)]
    lines = closed + ((end > begin) & (last != 0x0A))
    first, second = first % (lines + 1), second % (lines + 1)

    def offset(units: np.ndarray) -> np.ndarray:
        found = np.where(units > closed, end, begin)
        inside = (units > 0) & (units <= closed)
        found[inside] = ends.select((before + units)[inside])
        return found

    a, b = offset(np.minimum(first, second)), offset(np.maximum(first, second))
    at = points.rank(a)
    return lines, a, b, at - points.rank(begin), points.rank(b) - at


def _checked(markers: Sequence[str]) -> tuple[str, str, str]:
    """Three markers of which none can begin inside another or where two texts meet one."""
    for one in markers:
        for other in markers:
            if not one or (one != other and one in other) or any(
                    one[-n:] == other[:n] for n in range(1, min(len(one), len(other)))):
                raise ValueError("markers must not overlap")
    prefix, suffix, middle = markers
    if len({prefix, suffix, middle}) < 3:
        raise ValueError("markers must differ")
    return prefix, suffix, middle


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   markers: Sequence[str] = MARKERS) -> DataFrame:
    """The documents with `n_units` (long), `form` (plain, psm or spm), `prefix_chars`,
    `middle_chars` (long) and `output`."""
    prefix, suffix, middle = _checked(markers)
    p, s, m = prefix.encode(), suffix.encode(), middle.encode()
    safe, restored = shielded(docs, ("doc_id", "text"), _ADDED)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)

    def number(group: int) -> Column:
        return F.conv(F.substring("_digest", 8 * group - 7, 8), 16, 10).cast("long")

    text = F.coalesce("text", F.lit(""))
    plain = (text == "") | (number(3) % 100 >= rate)
    for marker in (prefix, suffix, middle):
        plain = plain | F.contains(text, F.lit(marker))
    form = F.when(plain, "plain").when(number(4) % 100 < spm_rate, "spm").otherwise("psm")
    chosen = safe.withColumn("_digest", digest).select(
        *safe.columns, form.alias("form"), number(1).alias("_first"), number(2).alias("_second"))
    kept = safe.columns
    result = T.StructType([*safe.schema.fields, T.StructField("n_units", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, words, bounds = as_words(batch.column("text"))
            lines, first, second, before, between = cuts(
                words, bounds, batch.column("_first").to_numpy(), batch.column("_second").to_numpy())
            forms = batch.column("form")
            names = forms.to_pylist()
            outputs = []
            for name, x, a, b, z in zip(names, bounds.tolist(), first.tolist(), second.tolist(), bounds[1:].tolist()):
                if name == "plain":
                    outputs.append(data[x:z])
                elif name == "psm":
                    outputs.append(b"".join((p, data[x:a], s, data[b:z], m, data[a:b])))
                else:
                    outputs.append(b"".join((s, data[b:z], p, data[x:a], m, data[a:b])))
            hidden = np.array([name == "plain" for name in names], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(lines, pa.int64()), forms,
                 pa.array(before, pa.int64(), mask=hidden), pa.array(between, pa.int64(), mask=hidden),
                 pa.array(outputs, pa.binary()).cast(pa.string())], [f.name for f in result.fields])

    return restored(chosen.mapInArrow(cut, result))


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made from."""
    prefix, suffix, middle = _checked(markers)

    def between(after: str, until: str) -> Column:
        begin = F.instr(output, after) + len(after)
        return F.substring(output, begin, F.instr(output, until) - begin)

    rest = F.instr(output, middle) + len(middle)
    whole = F.substring(output, rest, F.length(output))
    return (F.when(form == "psm", F.concat(between(prefix, suffix), whole, between(suffix, middle)))
            .when(form == "spm", F.concat(between(prefix, middle), whole, between(suffix, prefix)))
            .otherwise(output))
