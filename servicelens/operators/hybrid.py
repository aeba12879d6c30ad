"""Hybrid search from question to context: both sides, fused, with content and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.operators import fusion, search, tfidf, vectors
from servicelens.operators.block_max import BlockMaxIndex
from servicelens.operators.grams import SubstringIndex
from servicelens.session import ensure_checkpoint_dir


def _content(hits: DataFrame, records: DataFrame, row_id: str, content: Column,
             metadata: Sequence[str]) -> DataFrame:
    """A top list with content and metadata of its records; hits without a record have none.

    Both are kept by a reliable checkpoint, as each is used twice: a search and a scan of the records take
    place once.
    """
    ensure_checkpoint_dir(records.sparkSession)
    hits = hits.checkpoint()
    told = records.select(F.col(row_id).alias("_record"), content.alias("content"), *metadata)
    found = fusion.with_records(hits, told, "id", "_record").drop("_record").checkpoint()
    missing = hits.join(found.select("id"), "id", "left_anti")
    return found.unionByName(missing, allowMissingColumns=True)


def hybrid_search(records: DataFrame, vector_table: DataFrame | vectors.CellIndex, question: str,
                  vector: Sequence[float], k: int, content: Column, row_id: str = "id",
                  filters: Mapping[str, Any] | None = None, metadata: Sequence[str] = (),
                  columns: Sequence[str] = fields.RECORD_SEARCH_COLUMNS,
                  semantic_weight: float = fields.SEMANTIC_WEIGHT, by_record: bool = False,
                  method: str = "exact", index: SubstringIndex | None = None) -> DataFrame:
    """The k best of 2k hits from each side, with content and metadata.

    `by_record` adds up the scores of a record (id); otherwise each side keeps its hit
    (document_id). `filters` hold for the keyword side, and so does `index`, of the searched columns.
    """
    keyword = search.record_hits(records, question, filters, 2 * k, row_id, columns, content, index)
    keyword = _content(keyword.drop("content"), records, row_id, content, metadata)
    semantic = _content(vectors.search(vector_table, vector, 2 * k, method=method), records, row_id,
                        content, metadata)
    fuse = fusion.fuse_by_record if by_record else fusion.fuse_union
    return fuse(keyword, semantic, k, semantic_weight)


def light_hybrid_search(records: DataFrame, documents: DataFrame | tfidf.TextIndex | BlockMaxIndex, question: str,
                        k: int, content: Column, row_id: str = "id", doc_id: str = "doc_id", text: str = "text",
                        metadata: Sequence[str] = (), columns: Sequence[str] = fields.LIKE_SEARCH_COLUMNS,
                        index: SubstringIndex | None = None) -> DataFrame:
    """The light form: text similarity in place of vectors, half of the list from each side.

    The documents may be a stored index, and `index` one of the searched columns.
    """
    half = k // 2
    found = (tfidf.tfidf_search(documents, question, half, doc_id, text) if isinstance(documents, DataFrame)
             else documents.search(question, half))
    semantic = _content(found.withColumnRenamed("doc_id", "id"), records, row_id, content, metadata)
    keyword = search.light_hits(records, question, half, row_id, columns, content, index)
    return fusion.light_hybrid(semantic, _content(keyword.drop("content"), records, row_id, content, metadata), k)
