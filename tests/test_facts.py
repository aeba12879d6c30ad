from datetime import datetime

import pytest
from conftest import cells
from pyspark.sql import functions as F

from servicelens.operators import facts, filters, metrics, quality
from servicelens.operators.clean import derive


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- facts --------------------------------------------------------------------------------------

def test_last_row_per_case(rows):
    df = rows("case_no string, n int, parts_name string",
              ("A", 1, "p"), ("A", 2, "q"), (None, 3, "r"), (None, 4, "s"))
    out = facts.case_facts(df, ["n"])
    assert out.columns == ["case_no", "n"]
    assert plan_of(out).count("WindowGroupLimit") == 2     # once before the shuffle, once after
    assert sorted(cells(out), key=str) == [("A", 2), (None, 4)]


def test_distinct_rows_without_case_number(rows):
    df = rows("a int, parts_qty double, seq int", (1, 2.0, 1), (1, 3.0, 2))
    assert cells(facts.case_facts(df, ["seq"])) == [(1,)]


def test_split_keeps_all_part_rows(rows):
    df = rows("case_no string, n int, parts_name string", ("A", 1, "p"), ("A", 2, "q"))
    case_rows, part_rows = facts.split_facts(df, ["n"])
    assert case_rows.count() == 1 and part_rows.count() == 2


def test_derived_columns(rows):
    schema = ("sales_date timestamp_ntz, work_date timestamp_ntz, started_date timestamp_ntz, "
              "hour_meter double, elapsed string")
    df = rows(schema, (None, datetime(2024, 2, 1), datetime(2024, 1, 1), 10.0, "2カ月"),
              (datetime(2024, 12, 30), None, None, None, None))
    got = cells(derive(df), "base_date", "year", "month", "week", "hour_bin", "elapsed_days",
                "malfunction", "bulletin_no")
    assert got == [(datetime(2024, 2, 1), 2024, 2, 5, "0-250", 60.0, 0, None),
                   (datetime(2024, 12, 30), 2024, 12, 1, "不明", None, 0, None)]


# --- filters ------------------------------------------------------------------------------------

def test_range_bounds(rows):
    df = rows("i int, base_date timestamp_ntz", (1, datetime(2024, 1, 31)),
              (2, datetime(2024, 1, 31, 9)), (3, None), (4, datetime(2023, 12, 31)))
    keep = lambda a, b: [r[0] for r in filters.in_range(df, a, b).orderBy("i").collect()]  # noqa
    assert keep(None, "2024-01-31") == [1, 4]
    assert keep("2024-01-01", None) == [1, 2]
    assert keep(None, None) == [1, 2, 3, 4]
    assert filters.in_range(df.drop("base_date"), "2024-01-01").count() == 4


def test_inspection_words(rows):
    df = rows("service_class string", ("定期点検",), ("修理",), (None,), ("特自検",))
    assert cells(filters.without_words(df)) == [("修理",), (None,)]
    assert filters.without_words(df.withColumnRenamed("service_class", "x")).count() == 4


def test_exact_sample_is_repeatable(spark):
    df = spark.range(500).withColumnRenamed("id", "case_no")
    first = {r[0] for r in filters.sample_exactly(df, 50, ["case_no"]).collect()}
    again = {r[0] for r in filters.sample_exactly(df.repartition(9), 50, ["case_no"]).collect()}
    assert len(first) == 50 and first == again
    assert {r[0] for r in filters.sample_exactly(df, 50, ["case_no"], 7).collect()} != first
    assert filters.sample_exactly(df, 1000, ["case_no"]).count() == 500
    many = spark.range(20000).selectExpr("id AS case_no", "1 AS same")
    digest = F.md5(F.concat_ws("|", F.lit("42"), F.col("case_no").cast("string")))
    assert cells(filters.sample_exactly(many, 20, ["case_no"]), "case_no") == cells(
        many.orderBy(digest).limit(20), "case_no")
    assert filters.sample_exactly(many, 20, ["same"]).count() == 20


def test_filter_state(rows):
    df = rows("case_no int, machine_model string, hour_bin string, service_class string",
              (1, "U", "0-250", "修理"), (2, "V", "0-250", "修理"), (3, "U", "2000+", "修理"),
              (4, "U", "0-250", "法定検査"), (5, None, "0-250", None))
    state = {"機種名": ["U"], "hour_bins": ["0-250"], "exclude_inspections": True,
             "use_sampling": True, "sample_size": 10, "series": ["absent column"]}
    assert cells(filters.apply_filters(df, state), "case_no") == [(1,)]
    assert filters.apply_filters(df, {}).count() == 5


def test_table_and_keyword_search(rows):
    df = rows("i int, a string, b string", (1, "Oil leak", None), (2, None, "POMPE"), (3, "x", "y"))
    assert cells(filters.table_search(df, "oil|pom.e"), "i") == [(1,), (2,)]
    assert filters.table_search(df, "").count() == 3
    assert cells(filters.keyword_search(df, " leak  pompe "), "i") == [(1,), (2,)]
    assert filters.keyword_search(df, "leak", ["b", "absent"]).count() == 0
    assert filters.keyword_search(df, "  ").count() == 3


# --- aggregates ---------------------------------------------------------------------------------

def test_failing_models_agree_with_the_lookup_form(rows):
    df = rows("machine_model string, malfunction int", ("U", 1), ("U", 0), ("U", 0), ("V", 1),
              ("V", 1), (None, 1), ("W", 0))
    want = [("V", 2, 2, 100.0), ("U", 1, 3, 33.33)]
    assert cells(metrics.failing_models(df)) == want
    assert sorted(cells(metrics.failing_models_by_lookup(df))) == sorted(want)
    assert cells(metrics.failing_models(df, 1)) == want[:1]


def test_months_are_filled(rows):
    day = lambda m, d=3: datetime(2024, m, d)
    df = rows("base_date timestamp_ntz, malfunction int", (day(1), 1), (day(1, 31), 1), (day(3), 1),
              (day(5), 0), (None, 1))
    got = [(str(d), n) for d, n in cells(metrics.monthly_failures(df))]
    assert got == [("2024-01-31", 2), ("2024-02-29", 0), ("2024-03-31", 1)]
    assert metrics.monthly_failures(df.filter("malfunction = 0")).count() == 0


def test_part_share(rows):
    df = rows("parts_name string, malfunction int", ("a", 1), ("a", 1), ("b", 1), ("c", 0),
              (None, 1))
    assert cells(metrics.failing_part_share(df)) == [("a", 2, 66.67), ("b", 1, 33.33)]


def test_median_rules(rows):
    df = rows("d string, h double", ("x", 1.0), ("x", 3.0), ("x", None), (None, 9.0), ("y", None),
              ("z", 5.0), ("z", 5.0), ("z", 7.0))
    assert cells(metrics.exact_median(df, "d", "h")) == [("z", 5.0), ("x", 2.0), ("y", None)]


@pytest.mark.parametrize("value", ["rand(3)", "floor(rand(3)*5)", "exp(40*rand(3))", "1.0"])
def test_median_matches_the_built_in_one(spark, value):
    # one group holds two thirds of the rows
    df = spark.range(5001).select(F.expr("case when id % 3 = 0 then id % 7 else 99 end").alias("g"),
                                  F.expr(f"cast({value} as double)").alias("v"))
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("v")).collect()}
    assert dict(cells(metrics.exact_median(df, "g", "v"))) == pytest.approx(want)


@pytest.mark.parametrize("outlier", ["1e12D", "double('Infinity')"])
def test_median_with_an_outlier(spark, outlier):
    df = spark.range(4000).select(F.expr("id % 3").alias("g"), F.expr(
        f"case when id = 17 then {outlier} else rand(5) end").alias("v"))
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("v")).collect()}
    assert dict(cells(metrics.exact_median(df, "g", "v"))) == pytest.approx(want)


def test_facets_and_bounds(rows):
    df = rows("machine_model string, series string, hour_bin string", ("U", None, "不明"),
              ("U", "s", "不明"))
    assert sorted(cells(metrics.facets(df))) == [
        ("hour_bin", "不明"), ("machine_model", "U"), ("series", "s")]
    assert cells(metrics.row_counts(df, F.col("series") == "s")) == [(1, 2)]


# --- quality ------------------------------------------------------------------------------------

def test_missing_rates(rows):
    df = rows("a int, b int, `c.d` int", (1, None, None), (1, 2, None))
    assert cells(quality.missing_rates(df)) == [("c.d", 100.0), ("b", 50.0)]
    assert cells(quality.missing_rates(df, 1)) == [("c.d", 100.0)]


def test_duplicates(rows):
    df = rows("case_no string", *[(c,) for c in "aaabbcd"], (None,), (None,))
    assert cells(quality.duplicate_keys(df)) == [("a", 3, 2), ("b", 2, 2)]
    assert cells(quality.duplicate_keys(df, n=1)) == [("a", 3, 2)]
    assert quality.duplicate_keys(df.filter("case_no = 'c'")).count() == 0


def test_value_distribution(rows):
    df = rows("machine_model string, series string", ("U", "s"), ("U", None), ("V", None))
    got = sorted(cells(quality.value_distribution(df, n=1)))
    assert got == [("machine_model", "U", 2, 1), ("series", "s", 1, 1)]
