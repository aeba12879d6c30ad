"""Cosine search over block-max postings: blocks that cannot hold a top document are not read.

Documents are put in order of their largest impact (weight over norm, what a term adds to a cosine) and
cut into blocks of equal size. Per term and block the index knows the largest impact. The sum of
these over a question's terms bounds the score of every document in the block. So a question first reads
the blocks with the highest bounds, which gives a score that k documents reach, and then only blocks
whose bound comes up to it. As blocks are in order of impact, the blocks to read lie close together in
the stored postings, and the scan skips row groups of the rest.

What is stored of a posting is the document's place in its block and the count of the term; the factors of
its impact are kept once, with the term and with the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.operators.tfidf import (
    CHUNK_DOCUMENTS, TextIndex, asked_weight, known_norm, listed_postings, query_weights, ranked, shared_codes,
)
from servicelens.sources.tables import number_rows

BLOCK_DOCUMENTS = 128
BROADCAST_DOCUMENTS = 1_000_000 # placed in one pass over the lists, about 100 bytes each; more take more passes
FIRST_BLOCKS = 4
ORDERED = 500_000               # postings that a task puts in order of term and document at a time
_LISTED_BLOCKS = 1000           # block numbers that go into the scan's own filter
_ROUNDING = 1e-9
_NUMBER_BITS = 40               # of a posting's key: the document's number


@dataclass
class Reading:
    """What a question has to read: `blocks` (block), a score that k documents reach (None: fewer do),
    and postings to read, first look included, against all postings of its terms."""

    blocks: DataFrame
    least: float | None
    rows: int
    all_rows: int


@dataclass
class BlockMaxIndex:
    """Lists (term, block, idf, top, places, counts), with the largest impact as top, and documents (block,
    place, doc_id, scale), where count * idf * scale is an impact. A term can have several lists in a block, with
    each document in one."""

    lists: DataFrame
    documents: DataFrame

    @property
    def postings(self) -> DataFrame:
        """(term, block, doc_id, impact), one row per posting."""
        return listed_postings(self.lists).join(self.documents, ["block", "place"]).select(
            "term", "block", "doc_id", (F.col("count") * F.col("idf") * F.col("scale")).alias("impact"))

    @property
    def tops(self) -> DataFrame:
        """(term, block, top, rows): largest impacts, and numbers of postings."""
        return self.lists.groupBy("term", "block").agg(F.max("top").alias("top"), F.sum(F.size("places")).alias("rows"))

    def write(self, path: str) -> None:
        """Store the index, the lists in order of term and block as they come."""
        self.lists.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lists")
        (self.documents.sortWithinPartitions("block", "place").write.mode("overwrite")
         .parquet(f"{path}/documents"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockMaxIndex:
        return cls(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/documents"))

    def plan(self, query: str, k: int, first_blocks: int = FIRST_BLOCKS) -> Reading:
        """The blocks that can hold one of the top k. A term with negative impacts only adds nothing
        to a bound, as a document may lack it."""
        wanted = query_weights(query)
        tops = self.tops.filter(F.col("term").isin(list(wanted)))
        most = F.greatest(F.col("top"), F.lit(0.0)) * asked_weight(F.col("term"), wanted)
        bounds = tops.groupBy("block").agg(F.sum(most).alias("bound"), F.sum("rows").alias("rows"))
        first = (bounds.orderBy(F.col("bound").desc(), "block").limit(first_blocks)
                 .agg(F.collect_list("block").alias("blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first())
        best = (self._dots(query).filter(F.col("block").isin(first["blocks"])).filter("dot > 0")
                .orderBy(F.col("dot").desc()).limit(k))
        least = best.agg(F.when(F.count("*") >= k, F.min("dot"))).first()[0]
        needed = bounds if least is None else bounds.filter(F.col("bound") >= least * (1 - _ROUNDING))
        total = bounds.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        again = needed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return Reading(needed.select("block"), least, first["rows"] + again, total)

    def _dots(self, query: str, blocks: DataFrame | None = None) -> DataFrame:
        """(doc_id, block, dot) of the documents that hold a term of the question, in these blocks."""
        wanted = query_weights(query)
        found, documents = self.lists.filter(F.col("term").isin(list(wanted))), self.documents
        if blocks is not None:
            span = blocks.agg(F.slice(F.collect_set("block"), 1, _LISTED_BLOCKS + 1).alias("listed"),
                              F.min("block").alias("low"), F.max("block").alias("high")).first()
            near = F.col("block").between(span["low"], span["high"])
            found, documents = found.filter(near), documents.filter(near)
            found = (found.filter(F.col("block").isin(span["listed"])) if len(span["listed"]) <= _LISTED_BLOCKS
                     else found.join(blocks, "block", "left_semi"))
        asked = asked_weight(F.col("term"), wanted) * F.col("idf") * F.col("count")
        dots = listed_postings(found).groupBy("block", "place").agg(F.sum(asked).alias("_dot"))
        return dots.join(documents, ["block", "place"]).select(
            "doc_id", "block", (F.col("_dot") * F.col("scale")).alias("dot"))

    def search(self, query: str, k: int = 10, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
        """(doc_id, score), best first: the same as of :class:`TextIndex`."""
        wanted = query_weights(query)
        reading = self.plan(query, k, first_blocks)
        norm = (self.lists.filter(F.col("term").isin(list(wanted)))
                .agg(known_norm(F.collect_set("term"), wanted)).scalar())
        dots = self._dots(query, reading.blocks).select("doc_id", "dot", F.lit(1.0).alias("norm"))
        return ranked(dots, norm, k)


def _cut(postings: DataFrame, block_documents: int) -> DataFrame:
    """Lists by term and block of the postings (term, idf, count, number of the document, scale), of which a task
    orders about `ORDERED` at a time."""
    schema = "term string, block long, idf double, top double, places array<int>, counts array<int>"

    def lists(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        codes, terms = shared_codes([p.column("term") for p in parts])
        of = np.concatenate(codes)
        numbers, counts, idfs, scales = (np.concatenate([p.column(c).to_numpy() for p in parts])
                                         for c in ("number", "count", "idf", "scale"))
        parts.clear()
        order = np.argsort(of << _NUMBER_BITS | numbers)
        impacts = (counts * idfs * scales)[order]
        of, numbers, counts, idfs = of[order], numbers[order], counts[order], idfs[order]
        blocks, places = np.divmod(numbers, block_documents)
        starts = np.flatnonzero(np.diff(of << _NUMBER_BITS | blocks, prepend=-1))
        ends = pa.array(np.append(starts, len(of)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [terms.take(pa.array(of[starts])), pa.array(blocks[starts]), pa.array(idfs[starts]),
             pa.array(np.maximum.reduceat(impacts, starts)),
             pa.ListArray.from_arrays(ends, pa.array(places, pa.int32())),
             pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32()))],
            ["term", "block", "idf", "top", "places", "counts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                held += batch.num_rows
            if held >= ORDERED:
                yield lists(parts)
                held = 0
        if parts:
            yield lists(parts)

    return postings.mapInArrow(cut, schema)


def build_block_max(index: TextIndex, block_documents: int = BLOCK_DOCUMENTS,
                    broadcast_documents: int = BROADCAST_DOCUMENTS) -> BlockMaxIndex:
    """The block-max form of an index. Documents whose weights are all zero are left out: they have no
    cosine.

    The lists stay where they are, so their postings are not shuffled: numbers and scales of at most
    `broadcast_documents` documents are broadcast at a time, and the documents of the next numbers take another
    pass over the lists.
    """
    key = (F.col("chunk") * CHUNK_DOCUMENTS + F.col("place")).alias("_key")
    known = index.norms.filter("norm > 0").select(
        key, "doc_id", (1 / (F.col("length") * F.col("norm"))).alias("scale"),
        (-F.col("largest") / F.col("norm")).alias("_rank"))
    numbered = number_rows(known, ["_rank", "doc_id"], "_row").withColumn("number", F.col("_row") - 1)
    postings = listed_postings(index.lists.filter("docs is null").drop("docs")).select("term", "idf", "count", key)
    passes = []
    for first in range(0, max(1, numbered.count()), broadcast_documents):
        own = numbered.filter(F.col("number").between(first, first + broadcast_documents - 1))
        found = postings.join(F.broadcast(own.select("_key", "number", "scale")), "_key").drop("_key")
        passes.append(_cut(found, block_documents))
    documents = numbered.select(F.floor(F.col("number") / block_documents).alias("block"),
                                (F.col("number") % block_documents).cast("int").alias("place"), "doc_id", "scale")
    return BlockMaxIndex(reduce(DataFrame.unionAll, passes), documents)
