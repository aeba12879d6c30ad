"""Standard record table: build it, number it, store it, export it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.session import ensure_checkpoint_dir

_ROW_BITS = 33      # monotonically_increasing_id keeps the row position in the lower 33 bits


def to_standard_names(df: DataFrame) -> DataFrame:
    """Rename the known export headings; other columns keep their names."""
    return df.withColumnsRenamed({k: v for k, v in fields.STANDARD_NAMES.items()
                                  if k in df.columns})


def standard_records(df: DataFrame) -> DataFrame:
    """The 13 standard record columns, absent ones as typed nulls."""
    named = to_standard_names(df)

    def column(name: str) -> Column:
        if name in named.columns:
            return F.col(name)
        kind = ("double" if name in fields.NUMERIC_RECORD_COLUMNS
                else "timestamp_ntz" if name in fields.DATE_COLUMNS else "string")
        return F.lit(None).cast(kind).alias(name)

    return named.select(*(column(n) for n in fields.RECORD_COLUMNS))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "id",
                partitions: int | None = None) -> DataFrame:
    """Dense row numbers from 1 in the given order, without gathering rows in one task.

    The rows are range-partitioned and sorted, and frozen by a reliable checkpoint, so that their
    place in the layout cannot change between counting and numbering. The offsets table has one row
    per partition and is the only thing that is summed up globally or broadcast.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(count, *order).sortWithinPartitions(*order)
            .withColumn("_place", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright("_place", _ROW_BITS).alias("_part")
    sizes = laid.groupBy(part).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .select(*df.columns, (F.col("_before") + position + 1).alias(name)))


def spread_table(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """A stored table in place, or hash-partitioned by the key into as many parts as asked.

    A file can hold all its rows in one row group, which no reader can split; text work on it runs in
    one task then. Whoever knows such a table names a number of partitions. A table with many splits
    is best left in place.
    """
    return df.repartition(partitions, key) if partitions else df


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the stored table with this load."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header in UTF-8; every file starts with a byte order mark for spreadsheets.

    Spark's writer emits no mark, so it rides in front of the first column's heading.
    """
    first, *rest = df.columns
    marked = df.toDF("\ufeff" + first, *rest)
    (marked.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
