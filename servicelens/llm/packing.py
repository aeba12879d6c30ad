"""Best-fit packing of token sequences by bin completion.

Documents are tokenized and cut where they lie. The pieces of a stretch of rows are packed together
there: one pass, no shuffle, and no hot source. The few sequences of a stretch that are left with
room are opened again, and their pieces are dealt to fresh stretches and packed once more, so that
what the stretches lose at their ends is won back.

Bin completion: the largest piece left opens a sequence; the undominated ways to fill it up are
listed, fullest first, and tried depth first. A branch ends when its waste exceeds what a solution
better than the incumbent may waste in all. The incumbent is a best-fit decreasing solution at
first; when it reaches a lower bound nothing is searched. `Search` bounds the search of one stretch;
where it runs out the incumbent stands, with every piece placed.

Nulls and special cases: a null text is an empty one, whose only token is the end mark. Repeated
rows and null ids are packed row by row. Other columns are ignored by `pack`.
"""

from __future__ import annotations

import json
import math
import os
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import durable, only, sliced

CAPACITY = 4096
END_ID = 1
STRETCH_PIECES = 20_000         # pieces that are packed together
STRETCH_TOKENS = 16_000_000
CACHE_WORDS = 300_000

_encoders: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of texts, word by word, with a cache of two generations of words.

    The ids of a text are those of its parts between ASCII blanks, as the tokenizer never joins
    across a blank; likewise a letter and a mark behind it are apart (a letter as the tokenizer sees it:
    in lower case a capital can end in a combining mark). A full cache becomes the old
    generation, from which words in use move over, so memory is bounded and common words stay.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = _is_lower_byte_level(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def texts(self, texts: Sequence[str | None], end_id: int) -> list[bytes]:
        split = [(t or "").encode().split() for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        self._learn(set().union(*split) - self.young.keys())
        end = np.array([end_id], dtype="<u4").tobytes()
        get = self.young.__getitem__
        return [b"".join(map(get, words)) + end for words in split]

    def _learn(self, words: set[bytes]) -> None:
        known, other, ended = self.young, [], []
        for word in words & self.old.keys():
            known[word] = self.old[word]
        words = words - self.old.keys()
        stems: set[bytes] = set()
        for word in words:
            if word[-1] in b".,!?" and _ends_in_letter(word[:-1]):
                ended.append(word)
                stems.update((word[:-1], word[-1:]))
            else:
                stems.add(word)
        tokenize, pack = self.tokenizer.model.tokenize, _packed
        for word in stems - known.keys():
            plain = self.byte_level and _plain_letters(word)
            if plain:
                known[word] = pack([t.id for t in tokenize(plain)])
            else:
                other.append(word)
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in other],
                                                   add_special_tokens=False)
        for word, found in zip(other, encoded):
            known[word] = np.array(found.ids, dtype="<u4").tobytes()
        for word in ended:
            known[word] = known[word[:-1]] + known[word[-1:]]


def _is_lower_byte_level(path: str) -> bool:
    """The tokenizer lower-cases and then spells the bytes of each word in byte-level characters."""
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    normal = (parts.get("normalizer") or {}).get("normalizers") or []
    before = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return ([n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
            and [b["type"] for b in before] == ["Split", "ByteLevel"])


def _byte_letters() -> dict[int, str]:
    """Byte-level spelling: printable bytes are themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def _ends_in_letter(word: bytes) -> bool:
    return word[-1:].isalpha() or (word[-1:] >= b"\x80" and word.decode().lower()[-1].isalpha())


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _plain_letters(word: bytes) -> str | None:
    """The spelling of a word of Latin letters, which needs no other normalization; else None."""
    if word.isascii():
        return word.lower().decode() if word.isalpha() else None
    text = word.decode()
    if not text.isalpha() or max(text) > "\u024f" or "\u0130" in text:
        return None
    return text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)


def token_bytes(texts: Sequence[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """Per text its ids and the end mark, as little-endian unsigned 32-bit numbers."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path].texts(texts, end_id)


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing. Each bin lists lengths, which must be in descending order here."""
    room_bits, by_room, bins = 0, {}, []
    for length in lengths:
        fitting = room_bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                room_bits ^= 1 << room
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(length)
        room -= length
        if room:
            by_room.setdefault(room, []).append(chosen)
            room_bits |= 1 << room
    return bins


def _available(left: Counter, bits: int, chosen: list[int]) -> int:
    """Bit set of the lengths left when `chosen` is taken."""
    for length in chosen:
        if left[length] <= chosen.count(length):
            bits &= ~(1 << length)
    return bits


def _dominated(chosen: list[int], unused: int, waste: int) -> bool:
    """Some lengths of the filling, or none, could give way to one larger length left over."""
    sums = 1
    for length in chosen:
        sums |= sums << length
    reach, width = sums << 1, 1                 # sums + 1 .. sums + waste
    while width < waste:
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return bool(waste and reach & unused)


@dataclass(frozen=True)
class Search:
    """Bounds of the search for fewer sequences, each `math.inf` for none: sequences whose fillings are
    listed, fillings kept for one of them, steps that enumerate these, and lengths tried in each place."""

    nodes: float = 10_000
    choices: float = 8
    steps: float = 200
    widest: float = 4


def fillings(room: int, left: Counter, bits: int, search: Search = Search(), most_waste: float = math.inf
             ) -> list[list[int]]:
    """Undominated ways to fill the room from the lengths left, fullest first, none of more waste.

    Searched depth first, largest lengths first, within the bounds. `bits` is the bit set of the
    lengths in `left`.
    """
    found: list[tuple[int, list[int]]] = []
    full, steps = 0, search.steps
    stack: list[tuple[int, int, list[int]]] = [(room, room, [])]
    while stack and steps and full < search.choices:
        steps -= 1
        largest, space, chosen = stack.pop()
        fitting = _available(left, bits, chosen) & ((1 << (min(largest, space) + 1)) - 1)
        if not fitting:
            if space <= most_waste:
                found.append((space, chosen))
                full += not space
            continue
        nexts = []
        while fitting and len(nexts) < search.widest:
            length = fitting.bit_length() - 1
            fitting ^= 1 << length
            nexts.append((length, space - length, [*chosen, length]))
        stack.extend(reversed(nexts))
    found.sort(key=lambda x: x[0])
    looked = found if search.choices == math.inf else found[:4 * int(search.choices)]
    kept = [chosen for waste, chosen in looked
            if not _dominated(chosen, _available(left, bits, chosen), waste)]
    kept = kept if search.choices == math.inf else kept[:int(search.choices)]
    return kept or [chosen for _, chosen in found[:1]]


def least_bins(lengths: Sequence[int], capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): pieces over half the capacity have bins of their own, and
    of the others only what does not fit into the room that these leave needs more. Small pieces are
    disregarded up to each length in turn."""
    counts = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)
    pieces, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    small = np.arange(half + 1)                 # pieces shorter than this are left out
    alone = pieces[-1] - pieces[half]
    tall = capacity - small                     # pieces longer than this leave no room for the others
    partly, their = pieces[tall] - pieces[half], tokens[tall] - tokens[half]
    rest = tokens[half] - np.where(small > 0, tokens[small - 1], 0)
    return int((alone + np.maximum(0, -(-(rest - (partly * capacity - their)) // capacity))).max())


def complete(lengths: Sequence[int], capacity: int, search: Search = Search()) -> list[list[int]]:
    """As few bins as the search finds; each lists lengths."""
    if not len(lengths):
        return []
    ordered = sorted(lengths, reverse=True)
    best = best_fit(ordered, capacity)
    total = sum(ordered)
    bound, nodes = least_bins(ordered, capacity), search.nodes
    left = Counter(ordered)
    bits = sum(1 << length for length in left)
    allowed = (len(best) - 1) * capacity - total        # the waste of a solution with one bin less
    trail: list[tuple[list[int], list[list[int]]]] = []
    wasted, rest = 0, len(ordered)

    def take(chosen: list[int], sign: int) -> None:
        nonlocal bits, rest, wasted
        for length in chosen:
            left[length] -= sign
            bits = bits | 1 << length if left[length] else bits & ~(1 << length)
        rest -= sign * len(chosen)
        wasted += sign * (capacity - sum(chosen))

    while len(best) > bound and nodes:
        nodes -= 1
        if rest and wasted <= allowed:
            top = bits.bit_length() - 1
            left[top] -= 1
            bits = bits if left[top] else bits & ~(1 << top)
            options = [[top, *f] for f in fillings(capacity - top, left, bits, search, allowed - wasted)]
            left[top] += 1
            bits |= 1 << top
            options.reverse()
        else:
            if not rest and wasted <= allowed:
                best = [chosen for chosen, _ in trail]
                allowed = (len(best) - 1) * capacity - total
            options = []
        while trail and not options:                    # back to a bin with another filling
            chosen, options = trail.pop()
            take(chosen, -1)
        if not options:
            break
        chosen = options.pop()
        take(chosen, 1)
        trail.append((chosen, options))
    return best


def place(lengths: np.ndarray, capacity: int, search: Search = Search()) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its bin and its place there."""
    bins = complete(lengths.tolist(), capacity, search)
    waiting: dict[int, list[int]] = {}
    for i, length in enumerate(lengths.tolist()):
        waiting.setdefault(length, []).append(i)
    number = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    for n, chosen in enumerate(bins):
        at = 0
        for length in chosen:
            i = waiting[length].pop()
            number[i], offset[i] = n, at
            at += length
    return number, offset


_PIECE = ("doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, "
          "offset bigint, room bigint")
_NAMES = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "room"]


def _stretches(batches: Iterator[pa.RecordBatch], capacity: int, search: Search,
               first_id: int) -> Iterator[pa.RecordBatch]:
    """Pack pieces, stretch by stretch, into sequences numbered from `first_id`."""
    held: list[pa.RecordBatch] = []
    pieces = tokens = 0
    next_id = first_id

    def packed() -> pa.RecordBatch:
        nonlocal next_id
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lengths = rows.column("length").to_numpy(zero_copy_only=False)
        number, offset = place(lengths, capacity, search)
        room = capacity - np.bincount(number, weights=lengths).astype(np.int64)
        first, next_id = next_id, next_id + len(room)
        return pa.RecordBatch.from_arrays(
            [*(rows.column(n) for n in _NAMES[:5]), pa.array(number + first), pa.array(offset),
             pa.array(room[number])], _NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        pieces += batch.num_rows
        tokens += sum(batch.column("length").to_pylist())
        if pieces >= STRETCH_PIECES or tokens >= STRETCH_TOKENS:
            yield packed()
            held, pieces, tokens = [], 0, 0
    if held:
        yield packed()


def _cut(batches: Iterator[pa.RecordBatch], tokenize: Callable, capacity: int,
         chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, chars):
        ids, rows = batch.column("doc_id").to_pylist(), []
        for doc_id, coded in zip(ids, tokenize(batch.column("text").to_pylist())):
            for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                cut = coded[at:at + 4 * capacity]
                rows.append((doc_id, piece, at // 4, len(cut) // 4, cut))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         _NAMES[:5])


def _part_id(round_number: int) -> int:
    from pyspark import TaskContext
    context = TaskContext.get()
    return (round_number << 60) + ((context.partitionId() if context else 0) << 36)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         search: Search = Search()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary), sequence_id and offset.

    Pieces of a document longer than the capacity hold `capacity` ids each but the last. Sequence
    numbers are unique, not dense.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokenize(texts: list) -> list[bytes]:
            return token_bytes(texts, tokenizer_path, end_id)
        return _stretches(_cut(batches, tokenize, capacity), capacity, search, _part_id(0))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _stretches((b.select(_NAMES[:5]) for b in sliced(batches)), capacity, search,
                          _part_id(1))

    placed = durable(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
                     .mapInArrow(first, _PIECE))
    loose = F.col("room") > capacity // 128
    pieces, tokens = placed.where(loose).agg(F.count("*"), F.sum("length")).first()
    parts = 1 + max((pieces or 0) // STRETCH_PIECES, (tokens or 0) // STRETCH_TOKENS)
    dealt = (placed.where(loose).repartition(parts, F.xxhash64("doc_id", "piece", "sequence_id"))
             .mapInArrow(again, _PIECE))
    return placed.where(~loose).union(dealt).drop("room")
