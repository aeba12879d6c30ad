"""Split long texts into overlapping chunks at natural separators."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens import fields
from servicelens.functions.batches import sliced_arrays

BLANKS = " \t\n\r\f\v"


def _pieces(text: str, size: int, separators: Sequence[str]) -> list[str]:
    """Pieces of at most `size` characters that concatenate to the text.

    A text is cut in front of each occurrence of the first separator it holds; a piece still too
    long goes on with the later separators, and in the end is cut at the size.
    """
    if len(text) <= size:
        return [text]
    for i, sep in enumerate(separators):
        if sep in text:
            head, *rest = text.split(sep)
            cut = ([head] if head else []) + [sep + r for r in rest]
            return [q for p in cut for q in _pieces(p, size, separators[i + 1:])]
    return [text[i:i + size] for i in range(0, len(text), size)]


def split_text(text: str, size: int = fields.CHUNK_SIZE, overlap: int = fields.CHUNK_OVERLAP,
               separators: Sequence[str] = tuple(fields.CHUNK_SEPARATORS)) -> list[str]:
    """Greedy chunks of at most `size` characters; each starts with the whole pieces that ended
    the one before, as far as they fit in `overlap` characters and leave room for what follows."""
    chunks: list[str] = []
    held: list[str] = []
    length = 0
    for piece in _pieces(text, size, list(separators)):
        if held and length + len(piece) > size:
            chunks.append("".join(held).strip(BLANKS))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    chunks.append("".join(held).strip(BLANKS))
    return [c for c in chunks if c]


def chunk_array(c: Column, size: int = fields.CHUNK_SIZE, overlap: int = fields.CHUNK_OVERLAP,
                separators: Sequence[str] = tuple(fields.CHUNK_SEPARATORS)) -> Column:
    kind = pa.list_(pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else split_text(t, size, overlap, separators) for t in part.to_pylist()],
                          kind) for part in sliced_arrays(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # most records fit one chunk and never leave the JVM
    short = F.filter(F.array(F.trim(c, F.lit(BLANKS))), lambda t: t != "")
    return F.when(F.length(c) <= size, short).otherwise(chunks(F.when(F.length(c) > size, c)))


def chunk_documents(documents: DataFrame, text: str, size: int = fields.CHUNK_SIZE,
                    overlap: int = fields.CHUNK_OVERLAP,
                    separators: Sequence[str] = tuple(fields.CHUNK_SEPARATORS)) -> DataFrame:
    """One row per chunk: the other columns copied, plus `chunk_index` and `content`."""
    keep = [c for c in documents.columns if c != text]
    return documents.select(
        *keep, F.posexplode(chunk_array(F.col(text), size, overlap, separators))
        .alias("chunk_index", "content"))
