"""Data quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions.values import named
from servicelens.operators.metrics import long_form


def missing_rates(df: DataFrame, n: int = 20) -> DataFrame:
    """Share of missing values per column in percent, above 0 only, largest first.

    One aggregate over all columns; only its single row is turned into long form.
    """
    one_row = df.agg(*(F.avg(named(c).isNull().cast("int")).alias(c) for c in df.columns))
    rates = one_row.unpivot([], [named(c) for c in df.columns], "column_name", "_share")
    return (rates.select("column_name", (F.col("_share") * 100).alias("missing_pct"))
            .filter("missing_pct > 0")
            .orderBy(F.col("missing_pct").desc(), "column_name").limit(n))


def duplicate_keys(df: DataFrame, key: str = "case_no", n: int = 10) -> DataFrame:
    """Keys occurring more than once: the n most frequent, and how many such keys there are."""
    repeated = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cases"))
                .filter("cases > 1"))
    total = repeated.agg(F.count("*")).scalar()
    return (repeated.orderBy(F.col("cases").desc(), key).limit(n)
            .withColumn("duplicated_keys", total))


def value_distribution(df: DataFrame, columns: Sequence[str] = fields.DISTRIBUTION_COLUMNS,
                       n: int = 5) -> DataFrame:
    """The n most frequent values of each column, in long form.

    Values are counted before any shuffle, and the rank limit is applied per partition before the
    rows of one column come together, so the few column names are no bottleneck.
    """
    present = [c for c in columns if c in df.columns]
    counted = (long_form(df, present).filter("value is not null")
               .groupBy("field", "value").agg(F.count("*").alias("cases")))
    order = Window.partitionBy("field").orderBy(F.col("cases").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
