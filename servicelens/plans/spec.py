"""Run a JSON query spec over the fact tables as one logical plan.

    {"time_range": {"from": "2024-01-01", "to": null},
     "filters": [{"column": "機種名", "op": "==", "value": "U-30"}],
     "groupby": ["部門名"],
     "metrics": [{"name": "件数", "expr": "count"}, {"name": "数量", "expr": "sum:部品数量"}],
     "sort": {"by": "件数", "asc": false}, "topn": 10,
     "free_text_search": {"enabled": true, "keywords": ["漏れ"], "target_columns": ["作業内容"]}}

Columns may be named by export heading or standard name; the result keeps the names the spec used.
Unknown columns are skipped. An unknown operator, an unsupported expression or a repeated result
name raises ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens import fields
from servicelens.functions.fuzzy import fuzzy_match
from servicelens.functions.text import any_keyword, contains_text, matches
from servicelens.functions.values import any_of, named, to_number
from servicelens.operators.filters import in_range

Spec = Mapping[str, Any]


#: Column of a table of partial aggregates: the rows that each of its rows stands for.
ROWS = "_rows"


def resolve_name(columns: Collection[str], name: Any) -> str | None:
    """The column for a name in a spec; None if there is none."""
    if name in columns:
        return name
    standard = fields.standard_name(name) if isinstance(name, str) else None
    return standard if standard in columns else None


def resolve(df: DataFrame, name: Any) -> str | None:
    return resolve_name(df.columns, name)


def wants_parts(spec: Spec) -> bool:
    """Parts are queried when a metric expression mentions a part column."""
    exprs = [str(m.get("expr") or "") for m in spec.get("metrics") or []]
    return any(fields.PART_WORD in e or e.partition(":")[2] in fields.PART_COLUMNS for e in exprs)


def _literal(kind: T.DataType, value: Any) -> Column | None:
    """The value as a literal comparable with the column type; None if it can never be equal."""
    if isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    if isinstance(kind, T.NumericType):
        return F.lit(value + 0) if isinstance(value, (int, float)) else None
    if isinstance(kind, T.BooleanType):
        return F.lit(bool(value)) if value in (0, 1) else None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, (str, date, datetime)):
            return F.lit(str(value)).try_cast(kind)
    return None


def _member(df: DataFrame, column: str, values: list[Any]) -> Column:
    """True where the cell equals one of the values; false, never null, elsewhere."""
    literals = [_literal(df.schema[column].dataType, v) for v in values if v is not None]
    known = [v for v in literals if v is not None]
    return F.coalesce(named(column).isin(known), F.lit(False)) if known else F.lit(False)


def _as_list(value: Any) -> list[Any]:
    return value if isinstance(value, list) else [value]


def _text(column: str) -> Column:
    return named(column).cast("string")


_OPERATORS: dict[str, Callable[[DataFrame, str, Any], Column]] = {
    "==": lambda df, c, v: _member(df, c, [v]),
    "!=": lambda df, c, v: ~_member(df, c, [v]),
    "in": lambda df, c, v: _member(df, c, _as_list(v)),
    "not in": lambda df, c, v: ~_member(df, c, _as_list(v)),
    "contains": lambda df, c, v: contains_text(_text(c), str(v)),
    "regex": lambda df, c, v: matches(_text(c), str(v)),
    "fuzzy_search": lambda df, c, v: fuzzy_match(_text(c), str(v)),
}


def _filtered(df: DataFrame, spec: Spec) -> DataFrame:
    span = spec.get("time_range") or {}
    df = in_range(df, span.get("from"), span.get("to"))
    for item in spec.get("filters") or []:
        column, op = resolve(df, item.get("column")), item.get("op")
        if op not in _OPERATORS:
            raise ValueError(f"unknown filter operator: {op}")
        if column is not None:
            df = df.filter(_OPERATORS[op](df, column, item.get("value")))
    free = spec.get("free_text_search") or {}
    words, targets = free.get("keywords"), free.get("target_columns")
    if free.get("enabled") and words and targets:
        searched = [c for c in (resolve(df, t) for t in targets) if c is not None]
        df = df.filter(any_keyword([_text(c) for c in searched], words) if searched
                       else any_of([]))
    return df


def number_or_zero(df: DataFrame, name: str) -> Column:
    column = resolve(df, name)
    if column is None:
        return F.lit(0.0)
    kind = df.schema[column].dataType
    number = (named(column).cast("double") if isinstance(kind, (T.NumericType, T.BooleanType))
              else to_number(_text(column)))
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def _metric(df: DataFrame, expr: str) -> Column:
    kind, _, name = expr.partition(":")
    partial = ROWS in df.columns                # the numbers of a partial aggregate are totals
    if expr == "count":
        return F.coalesce(F.sum(ROWS), F.lit(0)) if partial else F.count("*")
    if kind == "sum" and name:
        return F.coalesce(F.sum(number_or_zero(df, name)), F.lit(0.0))
    if kind == "mean" and name:
        return F.sum(number_or_zero(df, name)) / F.sum(ROWS) if partial else F.avg(number_or_zero(df, name))
    raise ValueError(f"unsupported expression: {expr}")


def _sorted(result: DataFrame, rows: DataFrame, spec: Spec, keys: dict[str, str],
            metrics: list[str]) -> DataFrame:
    order = spec.get("sort") or {}
    by = order.get("by", fields.COUNT_NAME)
    if by not in result.columns:
        by = metrics[0]
    column = named(by)
    leading = [column]
    if isinstance(result.schema[by].dataType, T.StringType):
        # A text key sorts by number when every value of it is one. Metrics are numbers, so this is a
        # group key; the grouped rows tell as much as the groups, by a scan of one column.
        source = named(keys[by])
        numeric = rows.agg(F.bool_and(source.isNull() | to_number(source).isNotNull())).scalar()
        leading = [F.when(numeric, to_number(column)), F.when(~numeric, column)]
    ascending = bool(order.get("asc", False))
    first = [c.asc_nulls_last() if ascending else c.desc_nulls_last() for c in leading]
    return result.orderBy(*first, *(named(k).asc_nulls_last() for k in keys))


def run_spec(cases: DataFrame, parts: DataFrame, spec: Spec) -> DataFrame:
    """Filter, group, aggregate, sort and limit as the spec says."""
    return answer(parts if wants_parts(spec) else cases, spec)


def answer(table: DataFrame, spec: Spec) -> DataFrame:
    """The spec over one table: facts, or partial aggregates of them with a column `ROWS`."""
    df = _filtered(table, spec)
    keys = {g: resolve(df, g) for g in spec.get("groupby") or []}
    keys = {shown: column for shown, column in keys.items() if column is not None}
    metrics = [(m["name"], _metric(df, m.get("expr") or "count"))
               for m in spec.get("metrics") or [] if m.get("name")]
    metrics = metrics or [(fields.COUNT_NAME, _metric(df, "count"))]
    names = [*keys, *(name for name, _ in metrics)]
    if len(set(names)) < len(names):
        raise ValueError(f"result names are not unique: {names}")

    grouped = df.groupBy(*(named(column).alias(shown) for shown, column in keys.items()))
    result = grouped.agg(*(expr.alias(name) for name, expr in metrics))
    result = _sorted(result, df, spec, keys, [name for name, _ in metrics])
    topn = spec.get("topn")
    if isinstance(topn, int) and not isinstance(topn, bool) and topn > 0:
        result = result.limit(topn)
    return result
