"""Specs answered from stored partial aggregates.

A rollup holds, per day and per combination of its key columns, the number of rows and the totals of some
number columns. Counts, sums and means of any coarser grouping follow from these. A spec is answered from
a rollup if all columns it groups, filters or searches by are keys, all its metrics have totals, and its
time range has whole days as bounds; otherwise from the facts. The answers are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.plans import spec as specs

DAY = "base_date"


@dataclass
class Rollup:
    """`table` has the keys, the day, the totals and `specs.ROWS`; `columns` are those of the facts."""

    table: DataFrame
    keys: tuple[str, ...]
    totals: tuple[str, ...]
    columns: tuple[str, ...]

    def answers(self, spec: specs.Spec) -> bool:
        """Whether the spec needs nothing that the rollup has lost."""
        def missing(names: Sequence[Any], held: Sequence[str]) -> bool:
            found = (specs.resolve_name(self.columns, n) for n in names)
            return any(n is not None and n not in held for n in found)

        free = spec.get("free_text_search") or {}
        searched = (free.get("target_columns") or []) if free.get("enabled") and free.get("keywords") else []
        rows_by = [*(spec.get("groupby") or []), *(f.get("column") for f in spec.get("filters") or []), *searched]
        measured = [str(m.get("expr") or "").partition(":")[2] for m in spec.get("metrics") or [] if m.get("name")]
        span = spec.get("time_range") or {}
        return not (missing(rows_by, self.keys) or missing([m for m in measured if m], self.totals)
                    or not all(_is_day(span.get(end)) for end in ("from", "to")))

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    def read(self, spark: SparkSession, path: str) -> Rollup:
        """The same rollup from where it is stored."""
        return Rollup(spark.read.parquet(path), self.keys, self.totals, self.columns)


def _is_day(value: Any) -> bool:
    try:
        return not value or date.fromisoformat(str(value)) is not None
    except ValueError:
        return False


def build_rollup(facts: DataFrame, keys: Sequence[str], totals: Sequence[str] = ()) -> Rollup:
    """One partial aggregate of the facts. A bound of a range is a day's midnight, so rows at midnight and
    rows later that day are kept apart: the latter stand at noon."""
    keys = tuple(k for k in keys if k in facts.columns and k != DAY)
    totals = tuple(t for t in totals if t in facts.columns and t not in keys)
    by = [F.col(k) for k in keys]
    if DAY in facts.columns:
        midnight = F.date_trunc("day", F.col(DAY)).cast(facts.schema[DAY].dataType)
        noon = (midnight + F.expr("interval 12 hours")).cast(facts.schema[DAY].dataType)
        by.append(F.when(F.col(DAY) == midnight, midnight).otherwise(noon).alias(DAY))
    table = facts.groupBy(*by).agg(F.count("*").alias(specs.ROWS),
                                   *(F.sum(specs.number_or_zero(facts, t)).alias(t) for t in totals))
    return Rollup(table, keys, totals, tuple(facts.columns))


def run_spec(cases: DataFrame, parts: DataFrame, spec: specs.Spec, case_rollup: Rollup | None = None,
             part_rollup: Rollup | None = None) -> DataFrame:
    """:func:`specs.run_spec`, from the rollup of the table that it asks for where that suffices."""
    wanted, rollup = (parts, part_rollup) if specs.wants_parts(spec) else (cases, case_rollup)
    return specs.answer(rollup.table if rollup and rollup.answers(spec) else wanted, spec)
