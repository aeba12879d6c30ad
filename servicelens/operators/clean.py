"""Clean raw export rows and derive the analysis columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions import values
from servicelens.functions.text import normalize_everyday, normalize_cells
from servicelens.sources.tables import to_standard_names


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t == "string"]


def normalize_texts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Normalize every text column of the table (or the ones named).

    The cells of a row go through one rule as an array, so that the generated code does not grow with
    the columns. Only rows with rarer characters carry these cells over to Python.
    """
    chosen = text_columns(df) if columns is None else list(columns)
    if not chosen:
        return df
    raw, plain, rare = F.col("_raw"), F.col("_plain"), F.col("_rare")
    left = F.zip_with(raw, plain, lambda cell, done: F.when(done.isNull(), cell))
    cells = (df.withColumn("_raw", F.array(*map(values.named, chosen)))
             .withColumn("_plain", F.transform(raw, normalize_everyday))
             .withColumn("_rare", left)
             .withColumn("_rare", normalize_cells(F.when(F.exists(rare, lambda c: c.isNotNull()), rare))))
    return cells.withColumns({c: F.coalesce(F.get(plain, F.lit(i)), F.get(rare, F.lit(i)))
                              for i, c in enumerate(chosen)}).drop("_raw", "_plain", "_rare")


def _typed(df: DataFrame) -> dict[str, Column]:
    kinds = dict(df.dtypes)
    out: dict[str, Column] = {}
    for c in fields.DATE_COLUMNS:
        if c in kinds:
            # as a function of an array's cells: the many cases of a date would be inlined for each column
            out[c] = (F.transform(F.array(c), values.to_timestamp)[0] if kinds[c] == "string"
                      else F.col(c).cast("timestamp_ntz"))
    for c in fields.NUMBER_COLUMNS:
        if c in kinds:
            number = values.to_number(F.col(c)) if kinds[c] == "string" else F.col(c).cast("double")
            out[c] = F.nanvl(number, F.lit(None).cast("double"))
    return out


def base_date(df: DataFrame) -> Column:
    """First known of sales, finish and start date; null when none of the columns exists."""
    known = [F.col(c) for c in fields.BASE_DATE_ORDER if c in df.columns]
    return F.coalesce(*known, F.lit(None).cast("timestamp_ntz"))


def derive(df: DataFrame, exempt_words: Sequence[str] = fields.FLAG_EXEMPT_WORDS) -> DataFrame:
    """Add the derived columns. Every step is skipped when its input column is absent."""
    def present(names):
        return [F.col(c) for c in names if c in df.columns]

    out: dict[str, Column] = {}
    if "elapsed" in df.columns:
        out["elapsed_days"] = values.duration_days(F.col("elapsed").cast("string"))
    if "hour_meter" in df.columns:
        out["hour_bin"] = values.hour_bin(F.col("hour_meter"))
    out["malfunction"] = values.malfunction_flag(
        present(fields.MALFUNCTION_COLUMNS), exempt_words)
    notes = present(fields.BULLETIN_COLUMNS)
    out["bulletin_no"] = (values.extract_code(notes) if notes
                          else F.lit(None).cast("string"))
    # the calendar columns read the finished base date, so it is worked out once per row
    day = F.col("base_date")
    return (df.withColumns(out).withColumn("base_date", base_date(df))
            .withColumns({"year": F.year(day), "month": F.month(day), "week": F.weekofyear(day)}))


def normalize_records(raw: DataFrame,
                      exempt_words: Sequence[str] = fields.FLAG_EXEMPT_WORDS) -> DataFrame:
    """Raw export rows to clean records: names, texts, types, derived columns."""
    named = normalize_texts(to_standard_names(raw))
    return derive(named.withColumns(_typed(named)), exempt_words)
