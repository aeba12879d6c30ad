"""Aggregates that read less: rollups, one-pass dashboards, frequent values, exact fusion."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import cells
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servicelens.functions import fuzzy
from servicelens.operators import fusion, fuzzy_join, heavy, metrics, quality
from servicelens.plans import rollup
from servicelens.plans import spec as specs

# --- rollups ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    rand = random.Random(2)
    start = datetime(2024, 1, 1)
    data = [(rand.choice(["U-30", "U-15", None]), rand.choice(["north", "south", "", None]), rand.choice(["3", "20", "100"]),
             rand.choice([None, 1.0, 2.5]), rand.choice([None, "4", "x"]),
             rand.choice([None, start + timedelta(hours=12 * rand.randrange(40)), start + timedelta(days=rand.randrange(20))]),
             f"work {rand.randrange(9)}") for _ in range(500)]
    return spark.createDataFrame(data, "machine_model string, department string, series string, work_hours double, "
                                       "parts_qty string, base_date timestamp_ntz, work_content string")


SPECS = [
    {"groupby": ["機種名"], "metrics": [{"name": "n", "expr": "count"}, {"name": "h", "expr": "sum:作業時間"}]},
    {"groupby": ["department", "series"], "metrics": [{"name": "m", "expr": "mean:work_hours"}, {"name": "q", "expr": "sum:部品数量"}]},
    {"metrics": [{"name": "n"}, {"name": "m", "expr": "mean:作業時間"}, {"name": "z", "expr": "mean:no_such"}]},
    {"metrics": [{"name": "n"}, {"name": "m", "expr": "mean:作業時間"}], "filters": [{"column": "series", "op": "==", "value": "none"}]},
    {"groupby": ["series"], "sort": {"by": "series", "asc": True}, "topn": 2},
    {"groupby": ["machine_model"], "time_range": {"from": "2024-01-03", "to": "2024-01-10"}},
    {"groupby": ["machine_model", "no_such"], "filters": [{"column": "部門名", "op": "regex", "value": "th$"},
                                                          {"column": "no_such", "op": "==", "value": 1},
                                                          {"column": "machine_model", "op": "not in", "value": ["U-15"]}]},
    {"groupby": ["series"], "free_text_search": {"enabled": True, "keywords": ["nor"], "target_columns": ["department"]}},
]
KEYS, TOTALS = ["machine_model", "department", "series"], ["work_hours", "parts_qty"]


@pytest.mark.parametrize("body", SPECS)
def test_rollup_answers_like_the_facts(facts, body):
    made = rollup.build_rollup(facts, KEYS, TOTALS)
    assert made.answers(body)
    want = cells(specs.answer(facts, body))
    got = cells(rollup.run_spec(facts, facts, body, made, made))
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got, key=str), sorted(want, key=str)):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("body", [
    {"groupby": ["work_content"]}, {"groupby": ["base_date"]}, {"metrics": [{"name": "s", "expr": "sum:series"}]},
    {"filters": [{"column": "work_hours", "op": "==", "value": 1.0}]}, {"time_range": {"from": "2024-01-03 06:00:00"}},
    {"free_text_search": {"enabled": True, "keywords": ["work 1"], "target_columns": ["作業内容"]}},
])
def test_rollup_declines_what_it_has_lost(facts, body):
    made = rollup.build_rollup(facts, KEYS, TOTALS)
    assert not made.answers(body)
    assert sorted(cells(rollup.run_spec(facts, facts, body, made, made)), key=str) == sorted(cells(specs.answer(facts, body)), key=str)


def test_stored_rollup_is_read_instead_of_the_facts(spark, facts, tmp_path):
    made = rollup.build_rollup(facts, KEYS, TOTALS)
    made.write(str(tmp_path))
    stored = made.read(spark, str(tmp_path))
    df = rollup.run_spec(facts, facts, SPECS[0], stored)
    assert df.inputFiles() and all(str(tmp_path) in f for f in df.inputFiles())
    assert stored.table.count() < facts.count()
    empty = rollup.build_rollup(facts.limit(0), KEYS, TOTALS)
    assert cells(rollup.run_spec(facts, facts, {"metrics": [{"name": "n"}, {"name": "m", "expr": "mean:series"}]}, empty)) == [
        (500, pytest.approx(facts.agg(F.avg("series")).first()[0]))]


# --- dashboard --------------------------------------------------------------------------------------

def test_dashboard_in_one_pass(spark, rows, tmp_path):
    rand = random.Random(3)
    data = [(rand.choice(["A", "B", "C", None]), rand.choice(["K-1-1", None]), rand.choice(["x", "y"]),
             datetime(2024, 1 + i % 5, 3), rand.choice(["0-250", "不明"]), f"part {rand.randrange(30)}", rand.randrange(2))
            for i in range(300)]
    rows("machine_model string, bulletin_no string, location string, base_date timestamp_ntz, hour_bin string, "
         "parts_name string, malfunction int", *data).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    board = metrics.dashboard(df, df, models=2, top=4)
    assert board._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    got = {}
    for section, value, n, bad, rank in cells(board):
        got.setdefault(section, []).append((value, n, bad, rank))
    models = cells(metrics.failing_models(df, 2))
    assert [(v, b, n) for v, n, b, _ in sorted(got["machine_model"], key=lambda r: r[3])] == [r[:3] for r in models]
    parts = cells(metrics.failing_part_share(df, 4))
    assert [(v, b) for v, _, b, _ in sorted(got["parts_name"], key=lambda r: r[3])] == [r[:2] for r in parts]
    assert sorted((v, b) for v, _, b, _ in got["hour_bin"]) == sorted(cells(metrics.failures_by_hour_bin(df)))
    assert [(v, n) for v, n, _, _ in got["bulletin_no"]] == cells(metrics.bulletin_ranking(df))
    assert sorted((v, n) for v, n, _, _ in got["location"]) == sorted(cells(metrics.cases_by_location(df)))
    assert [b for _, _, b, _ in sorted(got["month"])] == [n for _, n in cells(metrics.monthly_failures(df))]
    assert {v for v, *_ in got["facet machine_model"]} == {"A", "B", "C"}


# --- frequent values ----------------------------------------------------------------------------------

@pytest.mark.parametrize("counters", [3, 50, 5000])
def test_frequent_values_are_exact(rows, counters):
    rand = random.Random(9)
    skewed = [f"v{min(int(rand.paretovariate(0.7)), 400)}" for _ in range(3000)]
    df = rows("a string, b string, c int, d string",
              *((v, f"own {i}", i % 4, None) for i, v in enumerate(skewed))).repartition(5)
    names = ["a", "b", "c", "d", "no_such"]
    assert sorted(cells(heavy.frequent_values(df, names, 5, counters))) == sorted(cells(quality.value_distribution(df, names)))


def test_shuffled_counters_do_not_follow_the_values(rows):
    df = rows("a string", *((f"own {i}",) for i in range(4000))).repartition(4)
    assert heavy.summaries(df, ["a"], 10).count() <= 4 * 11


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=20), max_size=6), st.integers(1, 6))
def test_counters_are_bounds(batches, size):
    held, truth = heavy.Counters(size), Counter()
    for batch in batches:
        held.add({str(v): n for v, n in Counter(batch).items()})
        truth.update(map(str, batch))
    assert len(held.held) <= size
    for value, n in truth.items():
        assert held.held[value] <= n <= held.held[value] + held.lowered


# --- exact fusion ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(4))
def test_exact_fusion(rows, seed):
    rand = random.Random(seed)
    sides = [{i: round(rand.random() ** 3, 2) if seed else 1.0 for i in rand.sample(range(150), rand.choice([0, 5, 90, 150]))}
             for _ in range(2)]
    sums = {i: 0.3 * sides[0].get(i, 0) + 0.7 * sides[1].get(i, 0) for i in sides[0].keys() | sides[1].keys()}
    want = sorted(((-s, i) for i, s in sums.items()))[:6]
    got = cells(fusion.fuse_exactly(*(rows("id int, score double", *s.items()) for s in sides), 6, first=4))
    assert [s for _, s in got] == pytest.approx([-s for s, _ in want])
    assert {i for i, _ in got} <= {i for i, s in sums.items() if s >= -want[-1][0] - 1e-9} if want else got == []


def test_exact_fusion_finds_what_two_cut_lists_miss(rows):
    keyword = rows("id int, score double", (1, 1.0), (2, 1.0), (9, 0.9))
    semantic = rows("id int, score double", (3, 1.0), (4, 1.0), (9, 0.9))
    cut = [side.orderBy(F.col("score").desc(), "id").limit(2) for side in (keyword, semantic)]
    assert 9 not in [i for i, _ in cells(fusion.fuse_by_record(*cut, 1))]
    assert cells(fusion.fuse_exactly(keyword, semantic, 1)) == [(9, pytest.approx(0.9))]


# --- fuzzy join -----------------------------------------------------------------------------------------

NEEDLES = ["smal wijet", "old anvl", "", None, "x", "ポンプ交", "W" * 70, "large  ring"]
NAMES = ["small widget", "SMALL WIDGET", "old anvil", "old ring", "x", "xx", "油圧ポンプ交換", "", None, "w" * 66 + "z", "anvil old",
         "large ring and more words behind it"]


@pytest.mark.parametrize("block", [1024, 2])
def test_fuzzy_join(rows, block):
    cells_ = rows("id int, name string", *enumerate(NAMES), (90, "old ring"))
    found = fuzzy_join.fuzzy_join(cells_, "name", rows("needle string", *((n,) for n in NEEDLES)), "needle", block=block)
    want = [(i, n, a, float(s)) for i, n in [*enumerate(NAMES), (90, "old ring")] for a in NEEDLES if a and n
            for s in fuzzy.partial_scores(a, [n]) if s > 70]
    assert sorted(cells(found, "id", "name", "needle", "score")) == sorted(want)
    assert len(want) >= 8
    with pytest.raises(ValueError):
        fuzzy_join.fuzzy_join(cells_, "name", cells_, "name", above=50)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abc "), min_size=1, max_size=9), st.text(st.sampled_from("abc "), min_size=1, max_size=12))
def test_shared_characters_rule_out_no_match(needle, cell):
    alphabet = {c: i for i, c in enumerate(sorted(set(needle)))}
    shared = fuzzy_join.shared_characters(*(fuzzy_join.character_counts([t], alphabet) for t in (cell, needle)))[0, 0]
    if fuzzy.partial_scores(needle, [cell])[0] > 70:
        assert shared > fuzzy_join._SHARE * min(len(needle), len(cell))
