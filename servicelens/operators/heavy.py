"""Most frequent values of columns with very many values, exact and proven.

Each task keeps a bounded number of counters per column (Misra-Gries): a value without a counter is at
most as frequent there as the counters have been lowered. The counters of all tasks add up, so the
shuffle follows tasks and counters and not the distinct values. The values with the highest sums are then
counted exactly. They are the answer if the last of them is more frequent than any other value can be;
columns for which this proof fails are counted in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from servicelens.functions.values import named
from servicelens.operators.metrics import long_form

COUNTERS = 2000


class Counters:
    """At most `size` counters of one column. `lowered` is what any value may have lost."""

    def __init__(self, size: int) -> None:
        self.size, self.lowered = size, 0
        self.held: Counter[str] = Counter()

    def add(self, counts: dict[str, int]) -> None:
        self.held.update(counts)
        if len(self.held) > self.size:
            cut = sorted(self.held.values(), reverse=True)[self.size]
            self.held = Counter({v: n - cut for v, n in self.held.items() if n > cut})
            self.lowered += cut


def summaries(df: DataFrame, columns: Sequence[str], counters: int = COUNTERS) -> DataFrame:
    """(field, value, count, lowered): the counters of all tasks; one row per task has no value and
    tells what its counters have been lowered by."""
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {c: Counters(counters) for c in columns}
        for frame in frames:
            for place, column in enumerate(columns):
                held[column].add(frame.iloc[:, place].value_counts().to_dict())
        rows = [(c, v, n, 0) for c, own in held.items() for v, n in own.held.items()]
        rows += [(c, None, 0, own.lowered) for c, own in held.items()]
        yield pd.DataFrame(rows, columns=["field", "value", "count", "lowered"])

    cells = df.select(*(named(c).cast("string").alias(c) for c in columns))
    return cells.mapInPandas(counted, "field string, value string, count bigint, lowered bigint")


def frequent_values(df: DataFrame, columns: Sequence[str], n: int = 5, counters: int = COUNTERS) -> DataFrame:
    """The n most frequent values of each column: (field, value, cases, rank), as `value_distribution`."""
    columns = [c for c in columns if c in df.columns]
    added = summaries(df, columns, counters).groupBy("field", "value").agg(
        F.sum("count").alias("count"), F.sum("lowered").alias("lowered"))
    by_field = Window.partitionBy("field").orderBy(F.col("value").isNull(), F.col("count").desc(), "value")
    # the highest sums of each column, one more for the bound, and the rows without a value
    listed = (added.withColumn("_place", F.row_number().over(by_field))
              .filter((F.col("_place") <= counters + 1) | F.col("value").isNull()))
    rows = listed.agg(F.collect_list(F.struct("field", "value", "count", "lowered", "_place"))).first()[0]
    bound = {c: sum(r["lowered"] for r in rows if r["field"] == c)
             + sum(r["count"] for r in rows if r["field"] == c and r["value"] is not None and r["_place"] > counters)
             for c in columns}
    chosen = [(r["field"], r["value"]) for r in rows if r["value"] is not None and r["_place"] <= counters]
    values = df.sparkSession.createDataFrame(chosen, "field string, value string")
    order = Window.partitionBy("field").orderBy(F.col("cases").desc(), "value")
    found = (long_form(df, columns).join(F.broadcast(values), ["field", "value"])
             .groupBy("field", "value").agg(F.count("*").alias("cases"))
             .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))
    told = found.groupBy("field").agg(F.count("*").alias("values"), F.min("cases").alias("least"))
    least = {r["field"]: r for r in told.agg(F.collect_list(F.struct("*"))).first()[0]}
    # every value is listed where nothing was lowered or left out; else the last must beat all unlisted ones
    proven = [c for c in columns if bound[c] == 0 or (c in least and least[c]["values"] == n and least[c]["least"] > bound[c])]
    others = [c for c in columns if c not in proven]
    found = found.filter(F.col("field").isin(proven))
    if not others:
        return found
    whole = long_form(df, others).filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("cases"))
    return found.unionByName(whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))
