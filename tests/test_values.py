from datetime import datetime

import pytest
from conftest import cells
from pyspark.sql import functions as F

from servicelens.functions import values


def column(rows, kind, inputs, expression):
    df = rows(f"i int, v {kind}", *enumerate(inputs))
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_duration(rows):
    got = column(rows, "string", ["27カ月", "15日", "1年2カ月", "42", "不明", None, "約3日12"],
                 values.duration_days)
    assert got == [810, 15, 60, 42, None, None, 3]


def test_hour_bins(rows):
    got = column(rows, "double", [-1.0, 249.9, 250.0, 500.0, 1000.0, 2000.0, None, float("nan")],
                 values.hour_bin)
    assert got == ["0-250", "0-250", "250-500", "500-1000", "1000-2000", "2000+", "不明", "不明"]


def test_numbers(rows):
    got = column(rows, "string", ["12", " 1.5 ", "-3e2", "12d", "1,000", "x", "", None, "inf"],
                 values.to_number)
    assert got == [12, 1.5, -300, None, None, None, None, None, float("inf")]


def test_timestamps(rows):
    got = column(rows, "string", ["2024-1-5", "2024/01/05 9:30", "2024年1月5日", "20240105",
                                  "2024-01-05 10:00:01", "2024-13-01", "x", "", None, "12:30"],
                 values.to_timestamp)
    day = datetime(2024, 1, 5)
    assert got == [day, day.replace(hour=9, minute=30), day, day,
                   day.replace(hour=10, second=1), None, None, None, None, None]


def test_month_first_and_month_names(rows):
    got = column(rows, "string", ["1/5/2024", "01/05/2024 9:30", "05-Jan-2024", "Jan 5, 2024", "january 5, 2024 09:30",
                                  "5 JAN 2024", "Sept 5, 2024", "13/5/2024", "05-Foo-2024", "1/5/20245", "1-5-2024"],
                 values.to_timestamp)
    day = datetime(2024, 1, 5)
    half = day.replace(hour=9, minute=30)
    assert got == [day, half, day, day, half, day, datetime(2024, 9, 5), None, None, None, day]


@pytest.mark.parametrize("row, flag", [
    (("エンジン", None, None), 1), ((None, None, None), 0), (("定期点検", None, None), 0),
    (("定期点検", "漏れ", None), 1), (("", "", ""), 0), ((None, None, "法定検査"), 0)])
def test_malfunction_flag(rows, row, flag):
    df = rows("a string, b string, c string", row)
    got = df.select(values.malfunction_flag([F.col(c) for c in "abc"])).first()[0]
    assert got == flag


def test_codes_look_through_the_columns(rows):
    df = rows("i int, a string, b string", (1, "対応 K-12-345", None), (2, "なし", "K-1-2"),
              (3, "k-1-2", None), (4, None, None), (5, "K-1-2 K-3-4", "K-5-6"))
    got = cells(df.orderBy("i").select(values.extract_code([F.col("a"), F.col("b")])))
    assert got == [("K-12-345",), ("K-1-2",), (None,), (None,), ("K-1-2",)]


def test_percent_rounds_half_to_even(rows):
    df = rows("a int, b int", (1, 800), (3, 800), (1, 3))
    assert cells(df.select(values.percent(F.col("a"), F.col("b")))) == [(0.12,), (0.38,), (33.33,)]


def test_words_pattern_is_literal(rows):
    df = rows("v string", ("a.b",), ("axb",), ("c+",))
    got = cells(df.filter(F.col("v").rlike(values.words_pattern(["a.b", "c+"]))))
    assert got == [("a.b",), ("c+",)]
