"""Row filters. Every one skips columns the table does not have."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions.text import any_keyword, keywords, matches
from servicelens.functions.values import any_of, named, words_pattern
from servicelens.operators.clean import text_columns
from servicelens.operators.grams import SubstringIndex

_HEX = 12       # hexadecimal digits of a digest that a sample's bound is written in


def _day(value: Any) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def in_range(df: DataFrame, start: Any = None, end: Any = None,
             column: str = "base_date") -> DataFrame:
    """Rows dated between two days. The upper bound is that day's midnight; null dates drop out
    as soon as one bound is given."""
    if column not in df.columns:
        return df
    if start:
        df = df.filter(F.col(column) >= _day(start))
    if end:
        df = df.filter(F.col(column) <= _day(end))
    return df


def in_values(df: DataFrame, chosen: Mapping[str, Sequence[Any] | None]) -> DataFrame:
    """Keep rows whose columns hold one of the chosen values; nothing chosen means no filter."""
    for column, allowed in chosen.items():
        if allowed and column in df.columns:
            df = df.filter(F.col(column).isin(list(allowed)))
    return df


def without_words(df: DataFrame, words: Sequence[str] = fields.INSPECTION_WORDS,
                  column: str = "service_class") -> DataFrame:
    """Drop rows whose column mentions any of the words; missing values stay."""
    if column not in df.columns:
        return df
    return df.filter(~any_of([F.col(column).rlike(words_pattern(words))]))


def sample_exactly(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if there are no more), the same ones on every run and layout.

    Rows are ranked by a digest of key and seed, so the draw depends on the rows only. The limit is
    the operator's purpose. Digests are spread evenly, so a bound a little above the share n of all
    rows keeps little more than n rows for the merge; should fewer pass, as with keys that repeat very
    often, all rows are ranked.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)),
                               *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key)))
    total = df.count()
    share = (n + 6 * math.sqrt(n) + 10) / max(total, 1)
    if share < 1:
        low = df.filter(digest < f"{int(share * 16 ** _HEX):0{_HEX}x}")
        if low.count() >= n:
            df = low
    return df.orderBy(digest, *key).limit(n)


def apply_filters(df: DataFrame, filters: Mapping[str, Any],
                  sample_key: Sequence[str] = ("case_no",)) -> DataFrame:
    """The dashboard's filter state applied to one fact table.

    Keys: `date_range` (start, end), the facet columns, `hour_bins`, `exclude_inspections`,
    `use_sampling` with `sample_size`. Facets may be named by heading or standard name.
    """
    state = {fields.standard_name(k): v for k, v in filters.items()}
    start, end = state.get("date_range") or (None, None)
    df = in_range(df, start, end)
    df = in_values(df, {c: state.get(c) for c in fields.FACET_COLUMNS})
    df = in_values(df, {"hour_bin": state.get("hour_bins")})
    if state.get("exclude_inspections"):
        df = without_words(df)
    if state.get("use_sampling") and state.get("sample_size"):
        df = sample_exactly(df, state["sample_size"], [c for c in sample_key if c in df.columns])
    return df


def table_search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows where the pattern (case-insensitive) is found in any text column; blank keeps all."""
    if not pattern:
        return df
    return df.filter(any_of(matches(named(c), pattern) for c in text_columns(df)))


def keyword_search(df: DataFrame, query: str, columns: Sequence[str] | None = None,
                   index: SubstringIndex | None = None, row_id: str = "id") -> DataFrame:
    """Rows holding any keyword of the query in any of the columns (default: all text columns).

    An index of these columns narrows the rows that are looked at.
    """
    words = keywords(query)
    if not words:
        return df
    chosen = text_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if index:
        df = index.narrowed(df, [[w] for w in words], row_id)
    return df.filter(any_keyword([named(c) for c in chosen], words))
