from datetime import datetime

import pytest
from conftest import cells

from servicelens.plans.spec import run_spec, wants_parts

SCHEMA = ("case_no string, machine_model string, work_hours double, malfunction int, text string, "
          "base_date timestamp_ntz")


@pytest.fixture()
def case_rows(rows):
    day = datetime(2024, 1, 31)
    return rows(SCHEMA, ("1", "x", 1.0, 1, "Oil leak", day), ("2", "x", 3.0, 0, "1.5", day),
                ("3", "y", None, 1, None, None), ("4", None, 5.0, 0, "a.c",
                                                  datetime(2024, 1, 31, 9)))


@pytest.fixture()
def part_rows(rows):
    return rows("machine_model string, parts_qty string", ("x", "2"), ("x", "bad"), ("y", None))


def keep(case_rows, column, op, value):
    out = run_spec(case_rows, case_rows, {
        "filters": [{"column": column, "op": op, "value": value}], "groupby": ["case_no"]})
    return sorted(r[0] for r in out.collect())


@pytest.mark.parametrize("column, op, value, kept", [
    ("machine_model", "==", "x", "12"), ("機種名", "==", "x", "12"),
    ("machine_model", "!=", "x", "34"), ("machine_model", "in", ["x", "y"], "123"),
    ("machine_model", "in", "y", "3"), ("machine_model", "not in", ["x"], "34"),
    ("machine_model", "==", 5, ""), ("machine_model", "!=", 5, "1234"),
    ("machine_model", "==", None, ""), ("machine_model", "not in", [None], "1234"),
    ("work_hours", "==", 3, "2"), ("work_hours", "==", "3", ""), ("malfunction", "==", True, "13"),
    ("base_date", "==", "2024-01-31", "12"), ("base_date", "==", "no date", ""),
    ("text", "contains", "OIL", "1"), ("text", "contains", "a.c", "4"), ("text", "contains", "n", ""),
    ("text", "regex", "^o.l|a.c", "14"), ("work_hours", "contains", "3.", "2"),
    ("text", "fuzzy_search", "oil leek", "1"), ("absent", "==", 1, "1234")])
def test_filters(case_rows, column, op, value, kept):
    assert "".join(keep(case_rows, column, op, value)) == kept


def test_unknown_operator_and_expression_are_errors(case_rows):
    with pytest.raises(ValueError):
        keep(case_rows, "text", "like", "x")
    with pytest.raises(ValueError):
        run_spec(case_rows, case_rows, {"metrics": [{"name": "m", "expr": "max:work_hours"}]})
    with pytest.raises(ValueError):
        run_spec(case_rows, case_rows, {"metrics": [{"name": "m"}, {"name": "m"}]})


def test_metrics_keep_null_groups_and_count_missing_as_zero(case_rows):
    out = run_spec(case_rows, case_rows, {
        "groupby": ["機種名"], "sort": {"by": "機種名", "asc": True},
        "metrics": [{"name": "n", "expr": "count"}, {"name": "mean", "expr": "mean:work_hours"},
                    {"name": "s", "expr": "sum:absent"}, {"expr": "count"}]})
    assert out.columns == ["機種名", "n", "mean", "s"]
    assert cells(out) == [("x", 2, 2.0, 0.0), ("y", 1, 0.0, 0.0), (None, 1, 5.0, 0.0)]


def test_global_metrics_and_default_count(case_rows):
    out = run_spec(case_rows, case_rows, {"metrics": [{"name": "m", "expr": "mean:作業時間"}]})
    assert cells(out) == [(2.25,)]
    assert run_spec(case_rows, case_rows, {}).columns == ["件数"]
    none = run_spec(case_rows, case_rows, {
        "time_range": {"from": "2030-01-01"}, "metrics": [{"name": "s", "expr": "sum:work_hours"}]})
    assert cells(none) == [(0.0,)]


def test_time_range_stops_at_midnight(case_rows):
    out = run_spec(case_rows, case_rows, {"time_range": {"from": None, "to": "2024-01-31"}})
    assert cells(out) == [(2,)]


def test_part_metrics_choose_the_part_rows(case_rows, part_rows):
    spec = {"groupby": ["machine_model"], "metrics": [{"name": "q", "expr": "sum:部品数量"}]}
    assert wants_parts(spec) and wants_parts({"metrics": [{"expr": "sum:parts_qty"}]})
    assert cells(run_spec(case_rows, part_rows, spec)) == [("x", 2.0), ("y", 0.0)]


def test_sort_falls_back_to_the_first_metric_with_nulls_last(case_rows):
    out = run_spec(case_rows, case_rows, {"groupby": ["machine_model"], "sort": {"by": "absent"},
                                          "metrics": [{"name": "n", "expr": "count"}]})
    assert cells(out) == [("x", 2), ("y", 1), (None, 1)]


def test_numeric_texts_sort_as_numbers(rows):
    df = rows("k string", ("10",), ("9",), (None,), ("1e1",))
    spec = {"groupby": ["k"], "sort": {"by": "k", "asc": False}}
    assert [r[0] for r in run_spec(df, df, spec).collect()] == ["10", "1e1", "9", None]
    other = rows("k string", ("10",), ("9",), ("x",))
    assert [r[0] for r in run_spec(other, other, spec).collect()] == ["x", "9", "10"]


def test_topn(case_rows):
    for topn, n in ((1, 1), (0, 3), (None, 3), ("2", 3), (True, 3)):
        out = run_spec(case_rows, case_rows, {"groupby": ["machine_model"], "topn": topn})
        assert out.count() == n


def test_free_text(case_rows):
    def n(**free):
        return run_spec(case_rows, case_rows, {"free_text_search": free}).first()[0]

    assert n(enabled=True, keywords=["LEAK", "a.c"], target_columns=["text", "absent"]) == 2
    assert n(enabled=True, keywords=["leak"], target_columns=["absent"]) == 0
    assert n(enabled=False, keywords=["leak"], target_columns=["text"]) == 4
    assert n(enabled=True, keywords=[], target_columns=["text"]) == 4


def test_one_aggregation_whatever_the_number_of_metrics(case_rows):
    out = run_spec(case_rows, case_rows, {
        "groupby": ["machine_model"],
        "metrics": [{"name": f"m{i}", "expr": "sum:work_hours"} for i in range(5)]})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
