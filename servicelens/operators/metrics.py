"""Dashboard aggregates. Each is one partial-then-final aggregation over the facts it is given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions.values import named, percent
from servicelens.session import ensure_checkpoint_dir



def top_counts(df: DataFrame, column: str, n: int | None = None, name: str = "cases") -> DataFrame:
    """Rows per non-null value, largest first, equal counts in value order; the first n."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
    ranked = counted.orderBy(F.col(name).desc(), column)
    return ranked.limit(n) if n else ranked


def failing_models(df: DataFrame, n: int = 20, model: str = "machine_model") -> DataFrame:
    """Models with the most malfunctions, their totals and malfunction rate in percent."""
    return (df.filter(F.col(model).isNotNull()).groupBy(model)
            .agg(F.count_if(F.col("malfunction") == 1).alias("malfunctions"),
                 F.count("*").alias("cases"))
            .filter("malfunctions > 0")
            .withColumn("rate_pct", percent(F.col("malfunctions"), F.col("cases")))
            .orderBy(F.col("malfunctions").desc(), model).limit(n))


def failing_models_by_lookup(df: DataFrame, n: int = 20, model: str = "machine_model") -> DataFrame:
    """Same table, with the totals looked up for the top models (0 if there is none).

    The top list has at most n rows, so broadcasting it is safe, and it prunes the second scan
    before the totals are counted.
    """
    top = top_counts(failures(df), model, n, "malfunctions")
    totals = (df.join(F.broadcast(top.select(model)), model, "left_semi")
              .groupBy(model).agg(F.count("*").alias("cases")))
    return (top.join(totals, model, "left")
            .withColumn("cases", F.coalesce("cases", F.lit(0)))
            .withColumn("rate_pct", percent(F.col("malfunctions"), F.col("cases"))))


def failures(df: DataFrame) -> DataFrame:
    return df.filter(F.col("malfunction") == 1)


def monthly_failures(df: DataFrame, date: str = "base_date") -> DataFrame:
    """Malfunctions per calendar month, labelled by month end; empty months in between show 0."""
    month = F.date_trunc("month", F.col(date)).cast("date")
    counted = (failures(df).filter(F.col(date).isNotNull())
               .groupBy(month.alias("_month")).agg(F.count("*").alias("_n")))
    span = counted.agg(F.min("_month").alias("lo"), F.max("_month").alias("hi"))
    months = span.filter("lo is not null").select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("_month"))
    return (months.join(counted, "_month", "left")
            .select(F.last_day("_month").alias("month_end"),
                    F.coalesce("_n", F.lit(0)).alias("malfunctions"))
            .orderBy("month_end"))


def failures_by_hour_bin(df: DataFrame) -> DataFrame:
    return top_counts(failures(df), "hour_bin", name="malfunctions")


def failing_part_share(parts: DataFrame, n: int = 10) -> DataFrame:
    """Most replaced parts among malfunctions and each one's share of those n."""
    top = top_counts(failures(parts), "parts_name", n, "replacements")
    whole = Window.partitionBy(F.lit(1))        # over at most n rows
    return top.withColumn("share_pct", percent(
        F.col("replacements"), F.sum("replacements").over(whole)))


def bulletin_ranking(cases: DataFrame, n: int = 10) -> DataFrame:
    return top_counts(cases, "bulletin_no", n)


def cases_by_location(cases: DataFrame) -> DataFrame:
    return top_counts(cases, "location")


def exact_median(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """Exact median of the non-null values per non-null group, largest first.

    Values are counted per (group, value) before the first shuffle. The counts are range-partitioned
    by group and value, so the ranges follow the data and an outlier has no effect on them; a
    checkpoint fixes them. A group is then narrowed to the one or two ranges that hold its middle
    ranks, and only the distinct values in those are put in order, by an external sort. A group may
    be arbitrarily large; one without values gets null.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (df.filter(F.col(by).isNotNull())
               .groupBy(by, F.col(value).cast("double").alias("_v"))
               .agg(F.when(F.col("_v").isNull(), 0).otherwise(F.count("*")).alias("_n")))
    bucketed = (counted.repartitionByRange(ranges, by, "_v")
                .withColumn("_b", F.spark_partition_id()).checkpoint())

    group = Window.partitionBy(by)
    upto = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (bucketed.groupBy(by, "_b")
               .agg(F.sum("_n").alias("_n"))
               .select(by, "_b", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
                       F.sum("_n").over(upto).alias("_upto"),
                       F.sum("_n").over(group).alias("_total"))
               .withColumn("_low", F.floor((F.col("_total") + 1) / 2))
               .withColumn("_high", F.floor(F.col("_total") / 2) + 1)
               .filter("_before < _high and _upto >= _low")
               .select(by, "_b", "_before", "_low", "_high"))

    def holds(rank: str) -> Column:
        return (F.col("_end") - F.col("_n") < F.col(rank)) & (F.col("_end") >= F.col(rank))

    inside = Window.partitionBy(by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (bucketed.join(buckets, [by, "_b"])
              .withColumn("_end", F.col("_before") + F.sum("_n").over(inside)))
    return (placed.groupBy(by)
            .agg(((F.max(F.when(holds("_low"), F.col("_v")))
                   + F.max(F.when(holds("_high"), F.col("_v")))) / 2).alias(name))
            .orderBy(F.col(name).desc_nulls_last(), by))


def dashboard(cases: DataFrame, parts: DataFrame, models: int = 20, top: int = 10) -> DataFrame:
    """All tables of the dashboard in long form, each fact table read once: (section, value, cases,
    malfunctions, rank).

    Sections of the cases: machine_model (by malfunctions), bulletin_no, location. Sections of the part
    rows: month (of malfunctions, in date order), hour_bin, parts_name (by malfunctions), and the facets. A
    row gives one cell to each section; cells are counted before the only shuffle, and lists are cut in
    front of the ranking one.
    """
    month = F.date_format(F.date_trunc("month", "base_date"), "yyyy-MM")
    wanted = {"machine_model": ("malfunctions", models), "bulletin_no": ("cases", top), "location": ("cases", None),
              "month": ("value", None), "hour_bin": ("malfunctions", None), "parts_name": ("malfunctions", top)}
    facets = {f"facet {c}": F.col(c) for c in (*fields.FACET_COLUMNS, "hour_bin") if c in parts.columns}

    def counted(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
        listed = F.array(*(F.struct(F.lit(n).alias("section"), c.cast("string").alias("value")) for n, c in cells.items()))
        each = df.select(F.explode(listed).alias("cell"), "malfunction").filter("cell.value is not null")
        return each.groupBy("cell.section", "cell.value").agg(
            F.count("*").alias("cases"), F.count_if(F.col("malfunction") == 1).alias("malfunctions"))

    both = counted(cases, {n: F.col(n) for n in ("machine_model", "bulletin_no", "location")}).unionByName(
        counted(parts, {"month": month, "hour_bin": F.col("hour_bin"), "parts_name": F.col("parts_name"), **facets}))
    ordered = {kind: [n for n, (k, _) in wanted.items() if k == kind] for kind in ("malfunctions", "cases")}
    both = both.filter(~F.col("section").isin(*ordered["malfunctions"], "month") | (F.col("malfunctions") > 0))
    key = F.when(F.col("section").isin(ordered["malfunctions"]), -F.col("malfunctions")).otherwise(-F.col("cases"))
    limit = F.coalesce(*(F.when(F.col("section") == n, size) for n, (_, size) in wanted.items() if size))
    whole = F.when(limit.isNull(), F.col("value"))          # rows of unlimited sections are not gathered
    rank = F.row_number().over(Window.partitionBy("section", whole).orderBy(key, "value"))
    ranked = both.withColumn("rank", rank).filter(F.col("rank") <= max(models, top))
    return ranked.filter(limit.isNull() | (F.col("rank") <= limit)).withColumn(
        "rank", F.when(limit.isNotNull(), F.col("rank")))


def date_bounds(df: DataFrame, date: str = "base_date") -> DataFrame:
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def facets(df: DataFrame, columns: Sequence[str] = (*fields.FACET_COLUMNS, "hour_bin")
           ) -> DataFrame:
    """Distinct non-null values of each filter column, in long form, from one pass."""
    present = [c for c in columns if c in df.columns]
    return long_form(df, present).filter("value is not null").distinct()


def row_counts(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that pass the condition, and all rows."""
    return df.agg(F.count_if(condition).alias("filtered"), F.count("*").alias("total"))


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value) rows for the columns, values as text."""
    texts = df.select(*(named(c).cast("string").alias(c) for c in columns))
    return texts.unpivot([], [named(c) for c in columns], "field", "value")
