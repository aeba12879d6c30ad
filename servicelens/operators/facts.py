"""Case-level and part-level fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servicelens import fields


def last_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key in load order; all null keys count as one key.

    Spark turns `row_number = 1` into a group limit in front of the shuffle, so a key that holds a
    third of all rows sends at most one row per input partition.
    """
    latest = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def case_facts(records: DataFrame, order: Sequence[str], key: str = "case_no") -> DataFrame:
    """One row per case without the part columns; distinct rows if there is no case number."""
    cases = records.drop(*fields.PART_COLUMNS)
    if key not in cases.columns:
        return cases.drop(*order).dropDuplicates()
    return last_per_key(cases, key, order)


def split_facts(records: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(case facts, part facts); part facts are all rows."""
    return case_facts(records, order), records
