"""Keyword searches over standard records, and what is reported about their results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions.automaton import MANY
from servicelens.functions.text import (
    any_keyword, ilike_any, keywords, like_any, light_snippet, record_snippet, relevance,
)
from servicelens.functions.values import named
from servicelens.operators.clean import text_columns
from servicelens.operators.grams import SubstringIndex, like_pieces


def ilike_search(records: DataFrame, query: str = "", filters: Mapping[str, Any] | None = None,
                 columns: Sequence[str] = fields.RECORD_SEARCH_COLUMNS,
                 index: SubstringIndex | None = None, row_id: str = "id") -> DataFrame:
    """Rows where a column is ILIKE the query, and every filter column equals its value.

    An empty query matches all rows; a filter without a value is skipped; a filter on a column the
    table does not have is an error. An index of the columns narrows the rows that are looked at.
    """
    if query and index:
        records = index.narrowed(records, [like_pieces(query)], row_id)
    if query:
        records = records.filter(ilike_any([F.col(c) for c in columns], query))
    for name, value in (filters or {}).items():
        if name not in records.columns:
            raise ValueError(f"no such column: {name}")
        if value is not None:
            records = records.filter(F.col(name) == F.lit(value))
    return records


def newest(df: DataFrame, n: int, row_id: str = "id") -> DataFrame:
    return df.orderBy(F.col(row_id).desc()).limit(n)


def record_hits(records: DataFrame, query: str, filters: Mapping[str, Any] | None = None,
                n: int = 20, row_id: str = "id",
                columns: Sequence[str] = fields.RECORD_SEARCH_COLUMNS,
                content: Column | None = None, index: SubstringIndex | None = None) -> DataFrame:
    """Newest matching records as scored hits: (id, score, content)."""
    found = newest(ilike_search(records, query, filters, columns, index, row_id), n, row_id)
    return found.select(F.col(row_id).alias("id"), F.lit(fields.KEYWORD_SCORE).alias("score"),
                        (record_snippet() if content is None else content).alias("content"))


def like_search(records: DataFrame, query: str, n: int = 10, row_id: str = "id",
                columns: Sequence[str] = fields.LIKE_SEARCH_COLUMNS,
                index: SubstringIndex | None = None) -> DataFrame:
    """First matching records in load order (LIKE, ASCII letters without case)."""
    if index:
        records = index.narrowed(records, [like_pieces(query)], row_id)
    return (records.filter(like_any([F.col(c) for c in columns], query))
            .orderBy(row_id).limit(n))


def light_hits(records: DataFrame, query: str, n: int = 10, row_id: str = "id",
               columns: Sequence[str] = fields.LIKE_SEARCH_COLUMNS,
               content: Column | None = None, index: SubstringIndex | None = None) -> DataFrame:
    """:func:`like_search` as scored hits: (id, score, content)."""
    return like_search(records, query, n, row_id, columns, index).select(
        F.col(row_id).alias("id"), F.lit(fields.LIGHT_KEYWORD_SCORE).alias("score"),
        (light_snippet() if content is None else content).alias("content"))


def relevance_hits(df: DataFrame, query: str, weights: Mapping[str, float] | None = None
                   ) -> DataFrame:
    """Rows with any keyword, with their relevance, in no order.

    Known columns, under their standard names or export headings, weigh 1 or 0.5; a table without any
    of them is searched in all its text columns at 0.5. A blank query returns all rows, unranked.
    """
    words = [w.lower() for w in keywords(query)]
    if not words:
        return df
    known = weights or fields.RELEVANCE_WEIGHTS
    standard = {c: fields.STANDARD_NAMES.get(c, c) for c in df.columns}
    chosen = {c: known[c if c in known else name] for c, name in standard.items()
              if c in known or name in known}
    chosen = chosen or {c: 0.5 for c in text_columns(df)}
    if len(words) >= MANY and min(chosen.values()) > 0:         # the relevance tells hits, in one look
        return df.withColumn("relevance", relevance(chosen, words)).filter("relevance > 0")
    found = df.filter(any_keyword([named(c) for c in chosen], words))
    return found.withColumn("relevance", relevance(chosen, words))


def relevance_search(df: DataFrame, query: str, tie_break: Sequence[str],
                     weights: Mapping[str, float] | None = None) -> DataFrame:
    """:func:`relevance_hits`, best first."""
    found = relevance_hits(df, query, weights)
    if "relevance" not in found.columns:
        return found
    return found.orderBy(F.col("relevance").desc(), *tie_break)


def combined_facts(cases: DataFrame, parts: DataFrame) -> DataFrame:
    """Cases and parts in one table, by column name; rows that are in both stay twice."""
    return cases.unionByName(parts, allowMissingColumns=True)


def result_summary(found: DataFrame, n: int = 3) -> DataFrame:
    """Hit count and the most frequent models and work contents: (section, value, cases, rank).

    All sections are counted in one pass; the rank limit works per partition before the rows of a
    section come together.
    """
    sections = [c for c in fields.SUMMARY_LABELS if c in found.columns]
    cells = [F.struct(F.lit("all").alias("section"), F.lit(None).cast("string").alias("value"))]
    cells += [F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("value"))
              for c in sections]
    counted = (found.select(F.inline(F.array(*cells)))
               .filter("section = 'all' or value is not null")
               .groupBy("section", "value").agg(F.count("*").alias("cases")))
    order = Window.partitionBy("section").orderBy(F.col("cases").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def summary_text(summary: DataFrame, query: str) -> DataFrame:
    """The summary as one line of text per section, in one row."""
    item = F.concat("value", F.lit("("), F.col("cases").cast("string"), F.lit("件)"))

    def line(section: str) -> Column:
        items = F.array_sort(F.collect_list(
            F.when(F.col("section") == section, F.struct("rank", item.alias("item")))))
        joined = F.array_join(F.transform(items, lambda x: x["item"]), "、")
        return F.when(F.size(items) > 0, F.concat(F.lit(fields.SUMMARY_LABELS[section]), joined))

    count = F.coalesce(F.max(F.when(F.col("section") == "all", F.col("cases"))), F.lit(0))
    before, after = (part.format(query=query) for part in fields.SUMMARY_FOUND)
    head = F.when(count == 0, F.lit(fields.SUMMARY_NOTHING.format(query=query))).otherwise(
        F.concat(F.lit(before), count.cast("string"), F.lit(after)))
    return summary.agg(F.concat_ws("\n", head, *map(line, fields.SUMMARY_LABELS)).alias("text"))


def fallback_search(cases: DataFrame, parts: DataFrame, query: str, tie_break: Sequence[str],
                    n: int = 50) -> tuple[DataFrame, DataFrame]:
    """(summary of all hits, the n most relevant hits) over cases and parts together."""
    both = combined_facts(cases, parts)
    shown = relevance_search(both, query, tie_break).limit(n)
    return result_summary(relevance_hits(both, query)), shown
