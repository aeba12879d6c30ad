"""Read sheet exports (one CSV file per sheet) into one table of raw text cells.

Layout: `<anywhere>/<workbook>/<sheet>.csv`. The header sits in the first or the second line. One
distributed read finds the layouts of all files: the width of each sheet over all its records, and
its first two records. A second one reads all files by one scan and joins each record with its file's
layout, which says where the record holds each heading. Jobs and plan follow neither files nor
layouts. The driver holds the caller's list of paths and the distinct headings.
"""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens import fields
from servicelens.functions.values import named
from servicelens.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

FILE_HEADING, SHEET_HEADING = "ファイル名", "シート名"
LOAD_ORDER = ["_file_order", "_block_start", "_row"]
_UNNAMED = "Unnamed"
_BLANK_SHARE = 0.8
_LOOKUPS_AT_ONCE = 16
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*:/{0,2}(?=/)"


@dataclass(frozen=True)
class Layout:
    header_row: int
    names: tuple[str, ...]     # cleaned, unique
    header: tuple[str, ...]    # as in the file


def clean_names(names: Sequence[str]) -> list[str]:
    """Trim the names and number the repeats: `a`, `a_1`, `a_2`."""
    seen: dict[str, int] = {}
    out = []
    for name in (str(n).strip() for n in names):
        seen[name] = seen.get(name, -1) + 1
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
    return out


def pick_header(rows: Sequence[Sequence[str | None]], width: int = 0) -> Layout:
    """The first of two rows with under 80% blank names, else row 0.

    Rows are judged at the width of the sheet: shorter ones are filled up with blanks.
    """
    width = max(width, *(len(row) for row in rows[:2]))
    rows = [[*row, *[None] * (width - len(row))] for row in rows[:2]]

    def named(row):
        return [v if v is not None and v.strip() else f"{_UNNAMED}: {i}"
                for i, v in enumerate(row)]

    def usable(row):
        names = named(row)
        return sum(n.startswith(_UNNAMED) for n in names) < len(names) * _BLANK_SHARE

    at = next((i for i, row in enumerate(rows) if usable(row)), 0)
    header = tuple("" if v is None else v for v in rows[at])
    return Layout(at, tuple(clean_names(named(rows[at]))), header)


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("multiLine", multi_line).option("escape", '"')
            .option("enforceSchema", True).option("ignoreMissingFiles", True)
            .option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False))


def _path(uri: Column) -> Column:
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist, in their order; others are logged."""
    def found(path: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    with ThreadPoolExecutor(_LOOKUPS_AT_ONCE) as pool:
        there = dict(zip(paths, pool.map(found, paths)))
    for path in paths:
        if not there[path]:
            log.warning("skipped %s: not found", path)
    return [p for p in paths if there[p]]


def _layout_columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = []
        for row in frame.itertuples():
            rows = [next(csv.reader([text.lstrip("\ufeff")], strict=False), [])
                    for text in row.heads]
            layout = pick_header([[v or None for v in r] for r in rows], row.width)
            made.append((row.uri, layout.header_row, list(layout.names), list(layout.header)))
        yield pd.DataFrame(made, columns=["uri", "header_row", "names", "header"])


def find_layouts(spark: SparkSession, paths: Sequence[str], multi_line: bool = False) -> DataFrame:
    """(uri, header_row, names, header): the layout of every file with records, from one read."""
    records = _records(spark, paths, multi_line, header=False).select(
        "uri", F.struct("block", "row").alias("place"), "record")
    unquoted = F.regexp_replace("record", r'"(?:[^"]|"")*"', "")
    fields_in = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","))) + 1
    first_two = Window.partitionBy("uri").orderBy("place")
    heads = (records.withColumn("_n", F.row_number().over(first_two)).filter("_n <= 2")
             .groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("_n", "record"))).alias("heads"))
             .withColumn("heads", F.transform("heads", lambda h: F.coalesce(h.record, F.lit("")))))
    widths = records.groupBy("uri").agg(F.coalesce(F.max(fields_in), F.lit(1)).alias("width"))
    return heads.join(widths, "uri").mapInPandas(
        _layout_columns, "uri string, header_row int, names array<string>, header array<string>")


def _records(spark: SparkSession, paths: Sequence[str], multi_line: bool, header: bool) -> DataFrame:
    """(uri, block, row, record): every record as it is written; `header` leaves out line 0 of each file.

    A reader of one column hands over each record with more fields as it is written, whatever the width
    of the lines before it.
    """
    raw = (_reader(spark, multi_line).option("header", header).option("columnNameOfCorruptRecord", "_record")
           .schema("_c0 string, _record string").csv(list(paths)))
    quoted = F.concat(F.lit('"'), F.replace("_c0", F.lit('"'), F.lit('""')), F.lit('"'))
    return raw.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("row"), F.coalesce("_record", quoted).alias("record"))


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, _SCHEME, "")


def _cells(record: Column, width: int) -> Column:
    """The fields of a record as an array of this width."""
    names = [f"_c{i}" for i in range(width)]
    parsed = F.from_csv(record, ", ".join(f"{n} string" for n in names), {
        "escape": '"', "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return F.transform(F.array(parsed), lambda p: F.array(*(p[n] for n in names)))[0]


def _without_header(rows: DataFrame) -> DataFrame:
    """The reader skips line 0 of each file; where line 1 is the header, the first record equal to it goes."""
    told = F.transform(F.slice("cells", F.lit(1), F.size("header")), lambda c: F.coalesce(c, F.lit("")))
    is_header = (F.col("header_row") == 1) & (told == F.col("header"))
    in_file = Window.partitionBy("uri").orderBy("block", "row")
    repeats = rows.filter(is_header).withColumn("_n", F.row_number().over(in_file)).filter("_n > 1").drop("_n")
    return rows.filter(~is_header).unionByName(repeats)


def sentinels_to_null(df: DataFrame, markers: Sequence[str] = tuple(fields.NULL_MARKERS)
                      ) -> DataFrame:
    """Text cells that are exactly one of the markers become null."""
    texts = [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({n: F.when(~named(n).isin(list(markers)), named(n)) for n in texts})


def read_exports(spark: SparkSession, paths: Sequence[str], sheets: Sequence[str] | None = None,
                 multi_line: bool = False) -> DataFrame:
    """All sheets of all files as one table of text cells under the export headings.

    Files that are missing, empty or unreadable are logged and skipped. `sheets` is an allow-list of
    sheet names. The columns in `LOAD_ORDER` give the load order of the rows.
    """
    chosen = _existing(spark, [p for p in paths if sheets is None or PurePosixPath(p).stem in sheets])
    if not chosen:
        return spark.createDataFrame([], T.StructType([]))
    ensure_checkpoint_dir(spark)
    order = spark.createDataFrame([(re.sub(_SCHEME, "", unquote(p)), i) for i, p in enumerate(chosen)],
                                  "bare string, _file_order int")
    path = F.col("path")
    layouts = (find_layouts(spark, chosen, multi_line).withColumn("path", _path(F.col("uri")))
               .withColumn("bare", _bare(path)).join(F.broadcast(order), "bare").checkpoint())
    empty = order.join(layouts, "bare", "left_anti").agg(
        F.count("*").alias("files"), F.min_by("bare", "_file_order").alias("first")).first()
    if empty["files"]:
        log.warning("skipped %d empty files, the first is %s", empty["files"], empty["first"])

    # of the layouts only their distinct headings come to the driver, in the order in which they appear
    each = layouts.select("_file_order", F.posexplode("names").alias("_place", "name"))
    first = each.groupBy("name").agg(F.min(F.struct("_file_order", "_place")).alias("at"))
    headings = [x["name"] for x in first.agg(F.array_sort(F.collect_list(F.struct("at", "name")))).first()[0]]
    if not headings:
        return spark.createDataFrame([], T.StructType([]))
    known = layouts.agg(F.max(F.size("names")).alias("width"), F.max("header_row").alias("header_row")).first()

    places = F.transform(F.array(*map(F.lit, headings)), lambda h: (F.array_position("names", h) - 1).cast("int"))
    # what is the same for all records of a file is worked out here, once per file
    placed = layouts.select("uri", "_file_order", "header_row", "header", places.alias("places"),
                            F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias(FILE_HEADING),
                            F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1).alias(SHEET_HEADING))
    # one row per file: the records stay where they are read, however many of them a file has
    rows = _records(spark, chosen, multi_line, header=True).join(F.broadcast(placed), "uri")
    rows = rows.withColumn("cells", _cells(F.col("record"), known["width"]))
    if known["header_row"]:
        rows = _without_header(rows)
    table = rows.select(
        *(F.get("cells", F.get("places", F.lit(i))).alias(h) for i, h in enumerate(headings)),
        FILE_HEADING, SHEET_HEADING, F.col("block").alias("_block_start"), F.col("row").alias("_row"), "_file_order")
    return sentinels_to_null(table)
