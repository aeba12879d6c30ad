"""The registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens import fields
from servicelens.functions import values
from servicelens.functions.chunking import BLANKS, chunk_documents
from servicelens.functions.fuzzy import fuzzy_match
from servicelens.functions.text import (
    has_any, light_snippet, light_text, metadata_json, normalize_text, record_snippet, record_text,
)
from servicelens.operators import (
    block_max, facts, filters, fusion, grams, heavy, hybrid, metrics, quality, search, tfidf, vectors,
)
from servicelens.operators.fuzzy_join import fuzzy_join
from servicelens.operators.clean import derive, normalize_records, text_columns
from servicelens.plans import rollup
from servicelens.plans.spec import run_spec
from servicelens.plans.standin import (
    DOCUMENT_RECORDS_SQL, ORDER, RECORDS_SQL, documents, documents_as_records, lines, table,
)
from servicelens.session import ensure_checkpoint_dir
from servicelens.sources.exports import FILE_HEADING, read_exports, sentinels_to_null
from servicelens.sources.tables import number_rows, standard_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DATES = ["sales_date", "work_date", "started_date"]
FLAG_INPUTS = ["category", "malfunction_content"]
KEY = [c for c in ORDER if c != "l_extendedprice"]


def query(sql: str | None = None, rounds: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL twin. `rounds` is a column of the twin's result that is rounded
    to six decimals behind its ORDER BY and LIMIT."""
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = (
                f"SELECT * REPLACE (round({rounds}, 6) AS {rounds}) FROM ({sql})" if rounds else sql)
        return build

    return register


def on_records(sql: str) -> str:
    return f"WITH {RECORDS_SQL} {sql}"


def on_documents(sql: str) -> str:
    return f"WITH {DOCUMENT_RECORDS_SQL} {sql}"


def rounded(hits: DataFrame) -> DataFrame:
    """Scores to the six decimals that are compared; hits are found and ranked before."""
    return hits.withColumn("score", F.round("score", 6))


def scratch_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A new place in the shared folder for an index of these tables, so that no other result loses
    the files it reads."""
    kept = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{kept}-{uuid.uuid4().hex}"


def clean(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return derive(lines(spark, sf_dir, *names))


def cases(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return facts.case_facts(clean(spark, sf_dir, "case_no", *ORDER, *names), ORDER)


# --- derived columns and the first dashboard table ------------------------------------------

@query(on_records("""
SELECT machine_model, sum(malfunction)::BIGINT AS malfunctions, count(*) AS cases,
  round_even(sum(malfunction) / count(*) * 100, 2) AS rate_pct
FROM cases WHERE machine_model IS NOT NULL GROUP BY machine_model HAVING sum(malfunction) > 0
ORDER BY malfunctions DESC, machine_model LIMIT 20"""))
def top_models(spark, sf_dir):
    return metrics.failing_models(cases(spark, sf_dir, "machine_model", *FLAG_INPUTS))


@query(on_records("""
SELECT machine_model, sum(malfunction)::BIGINT AS malfunctions, count(*) AS cases,
  round_even(sum(malfunction) / count(*) * 100, 2) AS rate_pct
FROM clean WHERE machine_model IS NOT NULL GROUP BY machine_model HAVING sum(malfunction) > 0
ORDER BY malfunctions DESC, machine_model LIMIT 20"""))
def top_models_lookup(spark, sf_dir):
    return metrics.failing_models_by_lookup(clean(spark, sf_dir, "machine_model", *FLAG_INPUTS))


@query(on_records("""
SELECT year, month, week, count(*) AS cases, min(base_date) AS first_date FROM clean
GROUP BY year, month, week"""))
def base_date_parts(spark, sf_dir):
    return (clean(spark, sf_dir, *DATES).groupBy("year", "month", "week")
            .agg(F.count("*").alias("cases"), F.min("base_date").alias("first_date")))


@query(on_records("""
SELECT hour_bin, count(*) AS cases, min(hour_meter) AS lowest, max(hour_meter) AS highest
FROM clean GROUP BY hour_bin"""))
def hour_bins(spark, sf_dir):
    return (clean(spark, sf_dir, "hour_meter").groupBy("hour_bin")
            .agg(F.count("*").alias("cases"), F.min("hour_meter").alias("lowest"),
                 F.max("hour_meter").alias("highest")))


@query(on_records("""
SELECT category, malfunction, count(*) AS cases, count(malfunction_content) AS described
FROM clean GROUP BY category, malfunction"""))
def malfunction_flag(spark, sf_dir):
    return (clean(spark, sf_dir, *FLAG_INPUTS).groupBy("category", "malfunction")
            .agg(F.count("*").alias("cases"),
                 F.count("malfunction_content").alias("described")))


# --- fact tables ------------------------------------------------------------------------------

@query(on_records("""
SELECT case_no, l_linenumber, work_hours, hour_bin, base_date, kind FROM cases"""))
def case_dedup_last(spark, sf_dir):
    return cases(spark, sf_dir, "work_hours", "hour_meter", "kind", "sales_date", "work_date",
                 "started_date").select("case_no", "l_linenumber", "work_hours", "hour_bin",
                                        "base_date", "kind")


@query(on_records("""
SELECT series, 'cases' AS fact, count(*) AS rows, NULL::DOUBLE AS parts_qty FROM cases
GROUP BY series
UNION ALL
SELECT series, 'parts', count(*), sum(parts_qty) FROM clean GROUP BY series"""))
def fact_split(spark, sf_dir):
    case_rows, part_rows = facts.split_facts(
        clean(spark, sf_dir, "case_no", *ORDER, "series", "parts_code", "parts_name",
              "parts_qty"), ORDER)
    both = [(case_rows, "cases"), (part_rows, "parts")]
    counted = [df.groupBy("series").agg(
        F.lit(name).alias("fact"), F.count("*").alias("rows"),
        (F.sum("parts_qty") if "parts_qty" in df.columns else F.lit(None).cast("double"))
        .alias("parts_qty")) for df, name in both]
    return counted[0].unionByName(counted[1])


@query("""
SELECT DISTINCT l_returnflag AS warranty_class, l_linestatus AS kind, l_quantity AS work_qty
FROM lineitem""")
def fact_distinct_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("warranty_class"), F.col("l_linestatus").alias("kind"),
        F.col("l_quantity").alias("work_qty"))
    return facts.case_facts(rows, [])


# --- filters ------------------------------------------------------------------------------------

@query(on_records("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, machine_model, series, base_date FROM clean
WHERE base_date >= TIMESTAMP '1996-03-01' AND base_date <= TIMESTAMP '1998-06-30'
  AND machine_model IN ('Brand#11', 'Brand#12', 'Brand#21') AND series IN ('SMALL', 'ECONOMY')"""))
def filter_range_in(spark, sf_dir):
    df = clean(spark, sf_dir, *KEY, "machine_model", "series", *DATES)
    df = filters.in_range(df, "1996-03-01", "1998-06-30")
    df = filters.in_values(df, {"machine_model": ["Brand#11", "Brand#12", "Brand#21"],
                                "series": ["SMALL", "ECONOMY"], "kind": [], "absent": ["x"]})
    return df.select(*KEY, "machine_model", "series", "base_date")


@query(on_records("""
SELECT service_class, count(*) AS cases FROM clean
WHERE NOT coalesce(regexp_matches(service_class, '点検|検査|特自検|定期点検'), false)
GROUP BY service_class"""))
def filter_exclude(spark, sf_dir):
    return (filters.without_words(clean(spark, sf_dir, "service_class"))
            .groupBy("service_class").agg(F.count("*").alias("cases")))


@query(on_records("""
SELECT case_no, hour_bin, machine_model, service_class, base_date FROM cases
WHERE base_date >= TIMESTAMP '1997-01-01' AND base_date <= TIMESTAMP '1997-12-31'
  AND hour_bin IN ('不明', '2000+', '0-250')
  AND NOT coalesce(regexp_matches(service_class, '点検|検査|特自検|定期点検'), false)"""))
def dashboard_filters(spark, sf_dir):
    df = cases(spark, sf_dir, "machine_model", "service_class", "hour_meter", *DATES)
    df = filters.apply_filters(df, {
        "date_range": ("1997-01-01", "1997-12-31"), "hour_bins": ["不明", "2000+", "0-250"],
        "機種名": [], "exclude_inspections": True, "use_sampling": False})
    return df.select("case_no", "hour_bin", "machine_model", "service_class", "base_date")


@query(on_records("""
SELECT DISTINCT field, value FROM (
  SELECT unnest(['machine_model', 'series', 'kind', 'department', 'service_class', 'hour_bin'])
           AS field,
         unnest([machine_model, series, kind, department, service_class, hour_bin]) AS value
  FROM clean) WHERE value IS NOT NULL"""))
def facets(spark, sf_dir):
    return metrics.facets(clean(spark, sf_dir, *fields.FACET_COLUMNS, "hour_meter"))


@query(on_records("""
SELECT min(base_date) AS first_date, max(base_date) AS last_date FROM clean"""))
def date_bounds(spark, sf_dir):
    return metrics.date_bounds(clean(spark, sf_dir, *DATES))


@query(on_records("""
SELECT count(*) FILTER (WHERE machine_model = 'Brand#11') AS filtered, count(*) AS total
FROM cases"""))
def row_counts(spark, sf_dir):
    return metrics.row_counts(cases(spark, sf_dir, "machine_model"),
                              F.col("machine_model") == "Brand#11")


@query(on_records("""
SELECT case_no, kind FROM (
  SELECT case_no, kind, md5(concat_ws('|', '42', coalesce(CAST(case_no AS VARCHAR), ''))) AS d
  FROM cases) ORDER BY d, case_no NULLS FIRST LIMIT 1000"""))
def sample_exact(spark, sf_dir):
    return filters.sample_exactly(cases(spark, sf_dir, "kind"), 1000, ["case_no"]
                                  ).select("case_no", "kind")


# --- dashboard aggregates -------------------------------------------------------------------

@query(on_records("""
, m AS (SELECT CAST(date_trunc('month', base_date) AS DATE) AS mon, count(*) AS n FROM clean
        WHERE malfunction = 1 AND base_date IS NOT NULL GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(mon), max(mon), INTERVAL 1 MONTH)) AS DATE) AS mon
          FROM m)
SELECT last_day(spine.mon) AS month_end, coalesce(n, 0) AS malfunctions
FROM spine LEFT JOIN m ON spine.mon = m.mon"""))
def monthly_trend_filled(spark, sf_dir):
    return metrics.monthly_failures(clean(spark, sf_dir, *DATES, *FLAG_INPUTS))


@query(on_records("""
SELECT hour_bin, count(*) AS malfunctions FROM clean WHERE malfunction = 1 GROUP BY hour_bin"""))
def hour_bin_counts(spark, sf_dir):
    return metrics.failures_by_hour_bin(clean(spark, sf_dir, "hour_meter", *FLAG_INPUTS))


@query(on_records("""
, top AS (SELECT parts_name, count(*) AS replacements FROM clean WHERE malfunction = 1
          GROUP BY parts_name ORDER BY replacements DESC, parts_name LIMIT 10)
SELECT parts_name, replacements,
  round_even(replacements / sum(replacements) OVER () * 100, 2) AS share_pct FROM top"""))
def part_share(spark, sf_dir):
    return metrics.failing_part_share(clean(spark, sf_dir, "parts_name", *FLAG_INPUTS))


@query(on_records("""
SELECT bulletin_no, count(*) AS cases FROM cases WHERE bulletin_no IS NOT NULL
GROUP BY bulletin_no ORDER BY cases DESC, bulletin_no LIMIT 10"""))
def bulletin_rank(spark, sf_dir):
    return metrics.bulletin_ranking(cases(spark, sf_dir, "work_content", "work_note"))


@query(on_records("""
SELECT location, count(*) AS cases FROM cases WHERE location IS NOT NULL GROUP BY location"""))
def location_counts(spark, sf_dir):
    return metrics.cases_by_location(cases(spark, sf_dir, "location"))


@query(on_records("""
SELECT department, median(work_hours) AS median_hours FROM cases WHERE department IS NOT NULL
GROUP BY department"""))
def dept_median(spark, sf_dir):
    return metrics.exact_median(cases(spark, sf_dir, "department", "work_hours"), "department",
                                "work_hours", "median_hours")


@query("""
SELECT l_returnflag AS warranty_class, median(l_extendedprice) AS median_price FROM lineitem
GROUP BY l_returnflag""")
def median_few_large_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("warranty_class"), "l_extendedprice")
    return metrics.exact_median(rows, "warranty_class", "l_extendedprice", "median_price")


# --- data quality -----------------------------------------------------------------------------

_QUALITY = ["case_no", "machine_model", "series", "category", "department", "service_class",
            "sales_date", "work_date", "hour_meter", "work_hours", "malfunction_content",
            "work_note", "parts_name", "bulletin_no", "base_date"]


@query(on_records(f"""
, s AS (SELECT {", ".join(f"count(*) - count({c}) AS {c}" for c in _QUALITY)}, count(*) AS n
        FROM clean),
l AS (SELECT unnest([{", ".join(f"'{c}'" for c in _QUALITY)}]) AS column_name,
             unnest([{", ".join(_QUALITY)}]) AS missing, n FROM s)
SELECT column_name, missing / n * 100 AS missing_pct FROM l WHERE missing > 0
ORDER BY missing_pct DESC, column_name LIMIT 20"""))
def missing_rates(spark, sf_dir):
    derived = {"bulletin_no", "base_date"}
    df = clean(spark, sf_dir, *(c for c in _QUALITY if c not in derived), "work_content",
               "started_date")
    return quality.missing_rates(df.select(*_QUALITY))


@query(on_records("""
, d AS (SELECT case_no, count(*) AS cases FROM clean WHERE case_no IS NOT NULL GROUP BY case_no
        HAVING count(*) > 1)
SELECT case_no, cases, (SELECT count(*) FROM d) AS duplicated_keys FROM d
ORDER BY cases DESC, case_no LIMIT 10"""))
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(lines(spark, sf_dir, "case_no"))


@query(on_records("""
, l AS (SELECT unnest(['machine_model', 'series', 'service_class', 'warranty_class']) AS field,
               unnest([machine_model, series, service_class, warranty_class]) AS value FROM clean),
c AS (SELECT field, value, count(*) AS cases FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT field, value, cases, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY field ORDER BY cases DESC, value) AS rank FROM c)
WHERE rank <= 5"""))
def value_distribution(spark, sf_dir):
    return quality.value_distribution(
        lines(spark, sf_dir, "machine_model", "series", "service_class", "warranty_class"))


_LONG_FIELDS = ["parts_code", "parts_name", "work_note", "case_no", "machine_model"]


@query(on_records(f"""
, l AS (SELECT unnest([{", ".join(f"'{c}'" for c in _LONG_FIELDS)}]) AS field,
               unnest([{", ".join(f"CAST({c} AS VARCHAR)" for c in _LONG_FIELDS)}]) AS value FROM clean),
c AS (SELECT field, value, count(*) AS cases FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT field, value, cases, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY field ORDER BY cases DESC, value) AS rank FROM c)
WHERE rank <= 5"""))
def frequent_values(spark, sf_dir):
    return heavy.frequent_values(lines(spark, sf_dir, *_LONG_FIELDS), _LONG_FIELDS)


_FACETS = [*fields.FACET_COLUMNS, "hour_bin"]


@query(on_records(f"""
, cells AS (
  SELECT unnest(['machine_model', 'bulletin_no', 'location']) AS section,
         unnest([machine_model, bulletin_no, location]) AS value, malfunction FROM cases
  UNION ALL
  SELECT unnest(['month', 'hour_bin', 'parts_name', {", ".join(f"'facet {c}'" for c in _FACETS)}]),
         unnest([strftime(base_date, '%Y-%m'), hour_bin, parts_name, {", ".join(_FACETS)}]), malfunction FROM clean),
counted AS (SELECT section, value, count(*) AS cases, sum(malfunction)::BIGINT AS malfunctions FROM cells
            WHERE value IS NOT NULL GROUP BY ALL),
shown AS (SELECT * FROM counted WHERE malfunctions > 0
          OR section NOT IN ('machine_model', 'hour_bin', 'parts_name', 'month')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY
             CASE WHEN section IN ('machine_model', 'parts_name') THEN -malfunctions ELSE -cases END, value) AS r,
             CASE section WHEN 'machine_model' THEN 20 WHEN 'bulletin_no' THEN 10 WHEN 'parts_name' THEN 10 END AS top
           FROM shown)
SELECT section, value, cases, malfunctions, CASE WHEN top IS NOT NULL THEN r::INTEGER END AS rank
FROM ranked WHERE top IS NULL OR r <= top"""))
def dashboard(spark, sf_dir):
    names = ["case_no", *ORDER, *fields.FACET_COLUMNS, "location", "parts_name", "work_content", "work_note",
             "hour_meter", *DATES, *FLAG_INPUTS]
    part_rows = clean(spark, sf_dir, *dict.fromkeys(names))
    case_rows, _ = facts.split_facts(part_rows, ORDER)
    return metrics.dashboard(case_rows, part_rows)


# --- query specs ------------------------------------------------------------------------------

def spec(spark: SparkSession, sf_dir: str, names: list[str], body: dict) -> DataFrame:
    """Run a spec whose tables hold the named columns."""
    part_rows = clean(spark, sf_dir, "case_no", *ORDER, *names)
    case_rows, _ = facts.split_facts(part_rows, ORDER)
    return run_spec(case_rows, part_rows, body)


@query(on_records("""
SELECT department AS "部門名", count(*) AS "件数" FROM cases GROUP BY department
ORDER BY count(*) DESC, department NULLS LAST LIMIT 10"""))
def spec_count(spark, sf_dir):
    return spec(spark, sf_dir, ["department"], {
        "groupby": ["部門名", "no_such_column"], "metrics": [{"name": "件数", "expr": "count"}],
        "sort": {"by": "件数", "asc": False}, "topn": 10})


@query(on_records("""
SELECT machine_model, series, sum(parts_qty) AS total_qty, count(*) AS n,
  avg(coalesce(work_hours, 0)) AS mean_hours, 0.0::DOUBLE AS nothing
FROM clean GROUP BY machine_model, series"""))
def spec_sum_mean(spark, sf_dir):
    return spec(spark, sf_dir, ["machine_model", "series", "parts_qty", "work_hours"], {
        "groupby": ["machine_model", "series"],
        "metrics": [{"name": "total_qty", "expr": "sum:部品数量"}, {"name": "n", "expr": "count"},
                    {"name": "mean_hours", "expr": "mean:作業時間"},
                    {"name": "nothing", "expr": "sum:no_such_column"}, {"expr": "count"}],
        "sort": {"by": "machine_model", "asc": True}})


@query(on_records("""
SELECT machine_model, category, count(*) AS "件数" FROM cases GROUP BY machine_model, category
ORDER BY "件数" DESC, machine_model NULLS LAST, category NULLS LAST LIMIT 25"""))
def spec_nullgroup(spark, sf_dir):
    return spec(spark, sf_dir, ["machine_model", "category"],
                {"groupby": ["machine_model", "category"], "topn": 25})


@query(on_records("""
SELECT series, kind, count(*) AS n FROM cases
WHERE base_date >= TIMESTAMP '1996-01-01' AND base_date <= TIMESTAMP '1999-12-31'
  AND kind = 'F' AND category IS DISTINCT FROM '定期点検'
  AND machine_model IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#12')
  AND (department IS NULL OR department NOT IN ('NATION_1', 'NATION_2'))
  AND contains(lower(location), 'mach') AND regexp_matches(service_class, '(?i)^[1-2]-[hu]')
GROUP BY series, kind"""))
def spec_filters_all(spark, sf_dir):
    names = ["series", "kind", "category", "machine_model", "department", "location",
             "service_class", *DATES]
    brands = [f"Brand#{i}" for i in (1, 2, 3, 4, 5, 12)]
    return spec(spark, sf_dir, names, {
        "time_range": {"from": "1996-01-01", "to": "1999-12-31"},
        "filters": [{"column": "種別", "op": "==", "value": "F"},
                    {"column": "カテゴリ", "op": "!=", "value": "定期点検"},
                    {"column": "機種名", "op": "in", "value": brands},
                    {"column": "部門名", "op": "not in", "value": ["NATION_1", "NATION_2"]},
                    {"column": "整備場所", "op": "contains", "value": "MACH"},
                    {"column": "整備区分", "op": "regex", "value": "^[1-2]-[hu]"},
                    {"column": "no_such_column", "op": "==", "value": 1}],
        "groupby": ["series", "kind"], "metrics": [{"name": "n", "expr": "count"}]})


@query(on_records("""
SELECT department, count(*) AS n, sum(parts_qty) AS qty FROM clean
WHERE contains(lower(work_content), 'red') OR contains(lower(work_content), 'k-50-')
   OR contains(lower(parts_name), 'red') OR contains(lower(parts_name), 'k-50-')
GROUP BY department"""))
def spec_free_text(spark, sf_dir):
    return spec(spark, sf_dir, ["department", "work_content", "parts_name", "parts_qty"], {
        "groupby": ["department"],
        "metrics": [{"name": "n", "expr": "count"}, {"name": "qty", "expr": "sum:部品数量"}],
        "free_text_search": {"enabled": True, "keywords": ["Red", "k-50-"],
                             "target_columns": ["作業内容", "部品品名", "no_such_column"]}})


def spec_rolled(spark: SparkSession, sf_dir: str, names: list[str], totals: list[str], body: dict) -> DataFrame:
    """The same from stored rollups by these names, with these totals."""
    part_rows = clean(spark, sf_dir, "case_no", *ORDER, *names, *totals)
    case_rows, _ = facts.split_facts(part_rows, ORDER)
    stored = []
    for name, table_ in (("case_rollup", case_rows), ("part_rollup", part_rows)):
        path, made = scratch_path(spark, sf_dir, name), rollup.build_rollup(table_, names, totals)
        made.write(path)
        stored.append(made.read(spark, path))
    return rollup.run_spec(case_rows, part_rows, body, *stored)


@query(on_records("""
SELECT series, kind, count(*) AS n, sum(coalesce(work_hours, 0)) AS hours, avg(coalesce(work_hours, 0)) AS mean_hours
FROM cases WHERE base_date >= TIMESTAMP '1996-01-01' AND base_date <= TIMESTAMP '1999-12-31'
  AND kind = 'F' AND machine_model IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#12')
  AND (department IS NULL OR department NOT IN ('NATION_1', 'NATION_2')) AND contains(lower(location), 'mach')
GROUP BY series, kind"""))
def spec_rollup(spark, sf_dir):
    brands = [f"Brand#{i}" for i in (1, 2, 3, 4, 5, 12)]
    return spec_rolled(spark, sf_dir, ["series", "kind", "machine_model", "department", "location", *DATES], ["work_hours"], {
        "time_range": {"from": "1996-01-01", "to": "1999-12-31"},
        "filters": [{"column": "種別", "op": "==", "value": "F"}, {"column": "機種名", "op": "in", "value": brands},
                    {"column": "部門名", "op": "not in", "value": ["NATION_1", "NATION_2"]},
                    {"column": "整備場所", "op": "contains", "value": "MACH"}],
        "groupby": ["series", "kind"],
        "metrics": [{"name": "n", "expr": "count"}, {"name": "hours", "expr": "sum:作業時間"},
                    {"name": "mean_hours", "expr": "mean:作業時間"}]})


@query(on_records("""
SELECT machine_model, series, sum(parts_qty) AS total_qty, count(*) AS n, 0.0::DOUBLE AS nothing
FROM clean GROUP BY machine_model, series"""))
def spec_rollup_parts(spark, sf_dir):
    return spec_rolled(spark, sf_dir, ["machine_model", "series"], ["parts_qty"], {
        "groupby": ["machine_model", "series"],
        "metrics": [{"name": "total_qty", "expr": "sum:部品数量"}, {"name": "n", "expr": "count"},
                    {"name": "nothing", "expr": "sum:no_such_column"}]})


@query(on_records("""
SELECT location, sum(coalesce(work_hours, 0)) AS hours, count(*) AS n FROM cases GROUP BY location
ORDER BY hours DESC, location NULLS LAST LIMIT 3"""))
def spec_sort_fallback(spark, sf_dir):
    return spec(spark, sf_dir, ["location", "work_hours"], {
        "groupby": ["location"], "topn": 3, "sort": {"by": "no_such_name"},
        "metrics": [{"name": "hours", "expr": "sum:作業時間"}, {"name": "n", "expr": "count"}]})


@query(on_records("""
SELECT parts_code, count(*) AS n FROM clean GROUP BY parts_code
ORDER BY CAST(parts_code AS DOUBLE) LIMIT 40"""))
def spec_sort_numeric_text(spark, sf_dir):
    return spec(spark, sf_dir, ["parts_code", "parts_qty"], {
        "groupby": ["parts_code"], "topn": 40, "sort": {"by": "parts_code", "asc": True},
        "metrics": [{"name": "n", "expr": "count"}, {"name": "", "expr": "sum:部品数量"}]})


@query(on_records("""
SELECT count(*) AS n, avg(coalesce(hour_meter, 0)) AS mean_meter,
  sum(coalesce(work_hours, 0)) AS hours FROM cases WHERE base_date >= TIMESTAMP '1997-01-01'"""))
def spec_global(spark, sf_dir):
    return spec(spark, sf_dir, ["hour_meter", "work_hours", *DATES], {
        "time_range": {"from": "1997-01-01", "to": None},
        "metrics": [{"name": "n"}, {"name": "mean_meter", "expr": "mean:アワメータ_HR"},
                    {"name": "hours", "expr": "sum:作業時間"}]})


def fuzzy_pairs_sql(needles: str, names: str) -> str:
    """CTE `pairs`: needles (column `needle`) and distinct names (column `name`) that score above 70.

    The longest common subsequence is one list per row of its table: each character of the needle
    folds the last row into the next. Windows slide over the longer text, cut off at both ends; over
    either one where both are equally long.
    """
    return f"""
cells AS (SELECT name, lower(name) AS cell, needle AS asked, lower(needle) AS needle
          FROM (SELECT DISTINCT name FROM ({names})), (SELECT DISTINCT needle FROM ({needles}))
          WHERE name <> '' AND needle <> ''),
sides AS (SELECT name, asked, needle AS a, cell AS b FROM cells WHERE length(cell) >= length(needle)
          UNION ALL SELECT name, asked, cell, needle FROM cells WHERE length(cell) <= length(needle)),
starts AS (SELECT *, unnest(range(2 - length(a), length(b) + 1)) AS first FROM sides),
windows AS (SELECT name, asked, a, b[greatest(first, 1):least(first + length(a) - 1, length(b))] AS w FROM starts),
tables AS (SELECT name, asked, a, w, list_reduce(
    list_transform(range(1, length(a) + 1), lambda k: [unicode(a[k])]),
    lambda above, c: list_transform(range(length(w) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE list_max(
      list_transform(range(1, j + 1), lambda i:
        greatest(above[i + 1], above[i] + (unicode(w[i]) = c[1])::INTEGER))) END),
    list_transform(range(length(w) + 1), lambda j: 0)) AS last_row FROM windows),
pairs AS (SELECT name, asked AS needle, max(200.0 * last_row[length(w) + 1] / (length(a) + length(w))) AS score
          FROM tables GROUP BY name, asked HAVING score > 70)"""


def fuzzy_names_sql(needle: str, names: str) -> str:
    """CTE `near`: the distinct names (of the query `names`, column `name`) that score above 70."""
    return f"""{fuzzy_pairs_sql(f"SELECT '{needle}' AS needle", names)},
near AS (SELECT name FROM pairs)"""


FUZZY_NEEDLE = "smal wijet"


@query(on_records(f""", {fuzzy_names_sql(FUZZY_NEEDLE, "SELECT parts_name AS name FROM clean")}
SELECT parts_name, sum(parts_qty) AS qty FROM clean WHERE parts_name IN (SELECT name FROM near)
GROUP BY parts_name"""))
def spec_fuzzy(spark, sf_dir):
    return spec(spark, sf_dir, ["parts_name", "parts_qty"], {
        "filters": [{"column": "部品品名", "op": "fuzzy_search", "value": FUZZY_NEEDLE}],
        "groupby": ["parts_name"], "metrics": [{"name": "qty", "expr": "sum:部品数量"}]})


@query(f"""WITH {fuzzy_pairs_sql(
    "SELECT substr(p_name, 2, 5) || substr(p_name, 8) AS needle FROM part WHERE p_partkey % 20 = 0",
    "SELECT p_name AS name FROM part")}
SELECT needle, name AS cell, round(score, 6)::DOUBLE AS score, count(*) AS parts FROM pairs JOIN part ON p_name = name
GROUP BY ALL""")
def fuzzy_part_pairs(spark, sf_dir):
    """Misspelt names of some parts against all parts."""
    parts = table(spark, sf_dir, "part")
    asked = parts.filter("p_partkey % 20 = 0").select(
        F.concat(F.substring("p_name", 2, 5), F.substring("p_name", 8, 100)).alias("needle"))
    found = rounded(fuzzy_join(parts.select("p_name"), "p_name", asked, "needle"))
    return found.groupBy("needle", F.col("p_name").alias("cell"), "score").agg(F.count("*").alias("parts"))


# --- text search ------------------------------------------------------------------------------

@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term
           FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM t GROUP BY term""")
def text_tokens(spark, sf_dir):
    return tfidf.vocabulary(documents(spark, sf_dir), "doc_id", "text")


_TFIDF_SQL = r"""
tok AS (SELECT {id} AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term
        FROM {table}),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id),
cnt AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
w AS (SELECT doc_id, term, n / length AS tf, df,
        n / length * ln((SELECT count(*) FROM {table}) / (df + 1)) AS weight
      FROM cnt JOIN len USING (doc_id) JOIN dfs USING (term))
"""
_COSINE_SQL = """
q AS (SELECT unnest([{terms}]) AS term, unnest([{weights}]::DOUBLE[]) AS qw),
known AS (SELECT * FROM q WHERE term IN (SELECT term FROM dfs)),
score AS (
  SELECT w.doc_id, sum(qw * weight) / (sqrt(sum(weight * weight))
      * (SELECT sqrt(sum(qw * qw)) FROM known)) AS score
  FROM w LEFT JOIN known USING (term) GROUP BY w.doc_id HAVING count(qw) > 0
    AND sum(weight * weight) > 0)
"""


def tfidf_sql(search_text: str, table_name: str, row_id: str) -> str:
    wanted = tfidf.query_weights(search_text)
    return (_TFIDF_SQL.format(table=table_name, id=row_id) + ","
            + _COSINE_SQL.format(terms=", ".join(f"'{t}'" for t in wanted),
                                 weights=", ".join(str(w) for w in wanted.values())))


SEARCH_TEXT = "The oninre ungber, vielle zzzunknown"


@query(f"""WITH {_TFIDF_SQL.format(table="documents", id="doc_id")}
SELECT doc_id, term, round(tf, 6) AS tf, df, round(weight, 6) AS weight FROM w""")
def tfidf_weights(spark, sf_dir):
    return tfidf.tfidf_weights(documents(spark, sf_dir)).select(
        "doc_id", "term", F.round("tf", 6).alias("tf"), "df", F.round("weight", 6).alias("weight"))


@query(f"""WITH {tfidf_sql(SEARCH_TEXT, "documents", "doc_id")}
SELECT doc_id, round(score, 6) AS score FROM score WHERE score > 0
ORDER BY round(score, 12) DESC, doc_id LIMIT 20""")
def tfidf_search(spark, sf_dir):
    return rounded(tfidf.tfidf_search(documents(spark, sf_dir), SEARCH_TEXT, 20))


@query(f"""WITH {tfidf_sql(SEARCH_TEXT, "documents", "doc_id")}
SELECT doc_id, round(score, 6) AS score FROM score WHERE score > 0
ORDER BY round(score, 12) DESC, doc_id LIMIT 10""")
def tfidf_index_search(spark, sf_dir):
    path = scratch_path(spark, sf_dir, "text_index")
    tfidf.build_index(documents(spark, sf_dir)).write(path)
    return rounded(tfidf.TextIndex.read(spark, path).search(SEARCH_TEXT, 10))


@query(f"""WITH {tfidf_sql(SEARCH_TEXT, "documents", "doc_id")}
SELECT doc_id, round(score, 6) AS score FROM score WHERE score > 0
ORDER BY round(score, 12) DESC, doc_id LIMIT 10""")
def tfidf_block_search(spark, sf_dir):
    return rounded(stored_blocks(spark, sf_dir).search(SEARCH_TEXT, 10))


def stored_blocks(spark: SparkSession, sf_dir: str) -> block_max.BlockMaxIndex:
    text_path, path = (scratch_path(spark, sf_dir, n) for n in ("text_index", "block_index"))
    tfidf.build_index(documents(spark, sf_dir)).write(text_path)
    block_max.build_block_max(tfidf.TextIndex.read(spark, text_path)).write(path)
    return block_max.BlockMaxIndex.read(spark, path)


@query("""
SELECT doc_id, lang, source FROM documents
WHERE contains(lower(text), 'ungber') OR contains(lower(text), 'vielle')
   OR contains(lower(lang), 'ungber') OR contains(lower(lang), 'vielle')
   OR contains(lower(source), 'ungber') OR contains(lower(source), 'vielle')""")
def keyword_any(spark, sf_dir):
    return filters.keyword_search(documents(spark, sf_dir), " Ungber  vielle "
                                  ).select("doc_id", "lang", "source")


@query(on_documents("""
, s AS (SELECT id, machine_model,
    CASE WHEN contains(lower(work_content), 'ungber') THEN 1.0 ELSE 0 END
    + CASE WHEN contains(lower(work_content), 'src1') THEN 1.0 ELSE 0 END
    + CASE WHEN contains(lower(machine_model), 'ungber') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(lower(machine_model), 'src1') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(lower(category), 'ungber') THEN 0.5 ELSE 0 END
    + CASE WHEN contains(lower(category), 'src1') THEN 0.5 ELSE 0 END AS relevance FROM doc)
SELECT id, machine_model, CAST(relevance AS DOUBLE) AS relevance FROM s WHERE relevance > 0"""))
def keyword_relevance(spark, sf_dir):
    found = search.relevance_search(documents_as_records(spark, sf_dir), "ungber SRC1", ["id"])
    return found.select("id", "machine_model", "relevance")


_KEYWORDS = 1000


def keyword_list(spark: SparkSession, sf_dir: str) -> list[str]:
    """The first words of the test items, in order: a long list of keywords that follows the data."""
    words = tfidf.vocabulary(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return words.orderBy("term").limit(_KEYWORDS).agg(F.collect_list("term")).first()[0]


_KEYWORDS_SQL = rf"""
kw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark
       ORDER BY term LIMIT {_KEYWORDS})"""


@query(on_documents(f""", {_KEYWORDS_SQL},
s AS (SELECT id, machine_model, CAST(count(*) FILTER (contains(lower(work_content), term))
    + 0.5 * count(*) FILTER (contains(lower(machine_model), term))
    + 0.5 * count(*) FILTER (contains(lower(category), term)) AS DOUBLE) AS relevance
  FROM doc, kw GROUP BY id, machine_model)
SELECT * FROM s WHERE relevance > 0"""))
def keyword_relevance_many(spark, sf_dir):
    found = search.relevance_search(documents_as_records(spark, sf_dir),
                                    " ".join(keyword_list(spark, sf_dir)), ["id"])
    return found.select("id", "machine_model", "relevance")


@query(f"""WITH {_KEYWORDS_SQL}
SELECT page_id, url FROM pages WHERE EXISTS (
  SELECT 1 FROM kw WHERE contains(lower(url), term) OR contains(lower(html), term))""")
def keyword_any_many(spark, sf_dir):
    return filters.keyword_search(table(spark, sf_dir, "pages"), " ".join(keyword_list(spark, sf_dir)),
                                  ["url", "html"]).select("page_id", "url")


@query(on_documents("""
SELECT id, machine_model, category FROM doc
WHERE (work_content ILIKE '%a_tion%the%' OR machine_model ILIKE '%a_tion%the%'
       OR category ILIKE '%a_tion%the%') AND machine_model = 'en'
ORDER BY id DESC LIMIT 20"""))
def ilike_search(spark, sf_dir):
    found = search.ilike_search(
        documents_as_records(spark, sf_dir), "A_tion%the", {"machine_model": "en", "category": None},
        ["work_content", "machine_model", "category"])
    return search.newest(found, 20).select("id", "machine_model", "category")


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(on_documents(f"""
SELECT id, machine_model FROM doc
WHERE {" OR ".join(f"{_FOLD.format(c)} LIKE '%évi%'" for c in ("work_content", "machine_model", "category"))}
ORDER BY id LIMIT 20"""))
def like_search(spark, sf_dir):
    records = documents_as_records(spark, sf_dir).withColumns(
        {"malfunction_content": F.col("machine_model"), "parts_name": F.col("category")})
    return search.like_search(records, "éVI", 20).select("id", "machine_model")


def stored_grams(spark: SparkSession, sf_dir: str) -> grams.SubstringIndex:
    path = scratch_path(spark, sf_dir, "grams")
    grams.build_grams(documents_as_records(spark, sf_dir), _DOC_COLUMNS).write(path)
    return grams.SubstringIndex.read(spark, path)


@query(on_documents("""
SELECT id, machine_model, category FROM doc
WHERE work_content ILIKE '%ción_ñ%lara%' OR machine_model ILIKE '%ción_ñ%lara%'
   OR category ILIKE '%ción_ñ%lara%'"""))
def ilike_indexed(spark, sf_dir):
    return search.ilike_search(documents_as_records(spark, sf_dir), "CIÓN_Ñ%LaRa", columns=_DOC_COLUMNS,
                               index=stored_grams(spark, sf_dir)).select("id", "machine_model", "category")


@query(on_documents(f"""
SELECT id, machine_model FROM doc
WHERE {" OR ".join(f"{_FOLD.format(c)} LIKE '%évi%'" for c in ("work_content", "machine_model", "category"))}
ORDER BY id LIMIT 20"""))
def like_indexed(spark, sf_dir):
    return search.like_search(documents_as_records(spark, sf_dir), "éVI", 20, columns=_DOC_COLUMNS,
                              index=stored_grams(spark, sf_dir)).select("id", "machine_model")


@query(on_documents("""
SELECT id, machine_model FROM doc
WHERE """ + " OR ".join(f"contains(lower({c}), '{w}')" for c in ("work_content", "machine_model", "category")
                        for w in ("ungber", "vielle", "src11"))))
def keyword_indexed(spark, sf_dir):
    return filters.keyword_search(documents_as_records(spark, sf_dir), "Ungber vielle SRC11", _DOC_COLUMNS,
                                  stored_grams(spark, sf_dir)).select("id", "machine_model")


@query(r"""
SELECT event_id, event_type FROM events
WHERE regexp_matches(event_type, '(?i)^SIGN|: 9\d') OR regexp_matches(props, '(?i)^SIGN|: 9\d')""")
def table_search(spark, sf_dir):
    return filters.table_search(table(spark, sf_dir, "events"), r"^SIGN|: 9\d"
                                ).select("event_id", "event_type")


# --- vectors and fusion -------------------------------------------------------------------------

_PROBES: dict[str, list[float]] = {}


def probe_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stored vector number 0, standing in for an embedded question. A question's vector comes from
    outside, so it is read once and is no part of a search."""
    if sf_dir not in _PROBES:
        _PROBES[sf_dir] = table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]
    return _PROBES[sf_dir]


_NEAREST_SQL = """
v AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[],
        (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score
      FROM embeddings ORDER BY score DESC, id LIMIT {k})
"""
_KEYWORD_SQL = """
k AS (SELECT id, 1.0::DOUBLE AS score FROM doc
      WHERE work_content ILIKE '%{word}%' OR machine_model ILIKE '%{word}%'
         OR category ILIKE '%{word}%' ORDER BY id DESC LIMIT {k})
"""
_DOC_COLUMNS = ["work_content", "machine_model", "category"]


_TOP_VECTORS_SQL = f"WITH {_NEAREST_SQL.format(k=10)} SELECT id, round(score, 6) AS score FROM v"


@query(_TOP_VECTORS_SQL)
def vector_topk(spark, sf_dir):
    return rounded(vectors.nearest(table(spark, sf_dir, "embeddings"), probe_vector(spark, sf_dir), 10))


def stored_cells(spark: SparkSession, sf_dir: str) -> vectors.CellIndex:
    """The index as a later session finds it: built and written, then read back."""
    path = scratch_path(spark, sf_dir, "cells")
    vectors.build_cells(table(spark, sf_dir, "embeddings")).write(path)
    return vectors.CellIndex.read(spark, path)


@query()
def vector_ivf(spark, sf_dir):
    index = stored_cells(spark, sf_dir).calibrated(10)
    return rounded(vectors.search(index, probe_vector(spark, sf_dir), 10, method="cells"))


@query()
def vector_recall(spark, sf_dir):
    """Recall of the approximate search by the number of probes, over every 20th vector."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "question")
    return stored_cells(spark, sf_dir).recalls(asked, 10)


@query(_TOP_VECTORS_SQL)
def vector_cells_full(spark, sf_dir):
    return rounded(stored_cells(spark, sf_dir).probe(probe_vector(spark, sf_dir), 10,
                                                     probes=vectors.CELLS))


@query(_TOP_VECTORS_SQL)
def vector_cells_exact(spark, sf_dir):
    return rounded(vectors.search(stored_cells(spark, sf_dir), probe_vector(spark, sf_dir), 10))


@query("""
SELECT question, id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS question, v.vec_id AS id, round(score, 6) AS score, row_number() OVER (
    PARTITION BY q.vec_id ORDER BY s.score DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v,
    LATERAL (SELECT list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score) s
  WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def vector_many(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "question")
    return rounded(vectors.nearest_many(rows, asked, 10))


def both_sides(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    keyword = search.record_hits(documents_as_records(spark, sf_dir), "ungber", n=2 * k,
                                 columns=_DOC_COLUMNS, content=F.col("category"))
    return keyword, vectors.nearest(table(spark, sf_dir, "embeddings"),
                                    probe_vector(spark, sf_dir), 2 * k)


@query(on_documents(f""", {_KEYWORD_SQL.format(word="ungber", k=20)}, {_NEAREST_SQL.format(k=20)}
SELECT * FROM (
  SELECT 'db_' || id AS document_id, score * (1 - 0.7::DOUBLE) AS score FROM k
  UNION ALL SELECT 'vec_' || id, score * 0.7::DOUBLE FROM v)
ORDER BY score DESC, document_id LIMIT 10"""), rounds="score")
def hybrid_union(spark, sf_dir):
    return rounded(fusion.fuse_union(*both_sides(spark, sf_dir, 10), 10))


@query(on_documents(f""", {_KEYWORD_SQL.format(word="ungber", k=20)}, {_NEAREST_SQL.format(k=20)}
SELECT coalesce(k.id, v.id) AS id, coalesce(k.score * (1 - 0.7::DOUBLE), 0)
  + coalesce(v.score * 0.7::DOUBLE, 0) AS score
FROM k FULL JOIN v ON k.id = v.id ORDER BY score DESC, id LIMIT 10"""), rounds="score")
def hybrid_record(spark, sf_dir):
    return rounded(fusion.fuse_by_record(*both_sides(spark, sf_dir, 10), 10))


@query(on_documents("""
, k AS (SELECT id, 1.0::DOUBLE AS score FROM doc WHERE """ + " OR ".join(
    f"{c} ILIKE '%ungber%'" for c in ("work_content", "machine_model", "category")) + f"""),
{_NEAREST_SQL.format(k=10**9)},
p AS (SELECT * FROM v WHERE score > 0)
SELECT coalesce(k.id, p.id) AS id, coalesce(k.score * (1 - 0.7::DOUBLE), 0) + coalesce(p.score * 0.7::DOUBLE, 0) AS score
FROM k FULL JOIN p ON k.id = p.id ORDER BY score DESC, id LIMIT 10"""), rounds="score")
def hybrid_exact(spark, sf_dir):
    keyword = search.ilike_search(documents_as_records(spark, sf_dir), "ungber", columns=_DOC_COLUMNS).select(
        "id", F.lit(fields.KEYWORD_SCORE).alias("score"))
    semantic = vectors.scored(table(spark, sf_dir, "embeddings"), probe_vector(spark, sf_dir)).filter("score > 0")
    return rounded(fusion.fuse_exactly(keyword, semantic, 10))


_QUESTION = "ungber"
_LIGHT_COLUMNS = ["work_content", "machine_model", "category"]


_LIGHT_SQL = f"""WITH {tfidf_sql(_QUESTION, "documents", "doc_id")},
s AS (SELECT 'doc_' || doc_id AS document_id, score, 0 AS side, doc_id AS id FROM score
      WHERE score > 0 ORDER BY round(score, 12) DESC, doc_id LIMIT 5),
l AS (SELECT 'struct_' || doc_id AS document_id, 0.8::DOUBLE AS score, 1 AS side, doc_id AS id
      FROM documents WHERE {" OR ".join(f"{_FOLD.format(c)} LIKE '%ungber%'" for c in ("text", "lang", "source"))}
      ORDER BY doc_id LIMIT 5),
f AS (SELECT * FROM (FROM s UNION ALL FROM l) ORDER BY score DESC, side, id LIMIT 10)
SELECT document_id, score, text AS content, lang AS machine_model
FROM f JOIN documents ON doc_id = id"""


@query(_LIGHT_SQL, rounds="score")
def hybrid_light(spark, sf_dir):
    return rounded(hybrid.light_hybrid_search(
        documents_as_records(spark, sf_dir), documents(spark, sf_dir), _QUESTION, 10,
        F.col("work_content"), metadata=["machine_model"], columns=_LIGHT_COLUMNS))


@query(_LIGHT_SQL, rounds="score")
def hybrid_light_stored(spark, sf_dir):
    """The same from stored indexes: block-max postings and grams."""
    return rounded(hybrid.light_hybrid_search(
        documents_as_records(spark, sf_dir), stored_blocks(spark, sf_dir), _QUESTION, 10, F.col("work_content"),
        metadata=["machine_model"], columns=_LIGHT_COLUMNS, index=stored_grams(spark, sf_dir)))


_CONTEXT_SQL = """
t AS (SELECT *, '【関連情報 - スコア: ' || printf('%.2f', round_even(score, 2)) || '】' || chr(10)
        || content || chr(10) AS context_text FROM hit),
b AS (SELECT {key}, score, context_text, row_number() OVER o AS position,
        sum(length(context_text)) OVER o AS used_chars
      FROM t WINDOW o AS (ORDER BY score DESC, {key}))
SELECT {key}, round(score, 6) AS score, context_text, CAST(position AS INTEGER) AS position,
  CAST(used_chars AS BIGINT) AS used_chars FROM b WHERE used_chars <= 4000"""


_HYBRID_CONTEXT_SQL = on_documents(f""", {_KEYWORD_SQL.format(word=_QUESTION, k=20)}, {_NEAREST_SQL.format(k=20)},
hit AS (SELECT document_id, f.score, machine_model || ' | ' || category || ' | ' || work_content AS content
  FROM (SELECT * FROM (
    SELECT 'db_' || id AS document_id, score * (1 - 0.7::DOUBLE) AS score, id FROM k
    UNION ALL SELECT 'vec_' || id, score * 0.7::DOUBLE, id FROM v)
  ORDER BY score DESC, document_id LIMIT 10) f JOIN doc USING (id)),
{_CONTEXT_SQL.format(key="document_id")}""")


@query(_HYBRID_CONTEXT_SQL)
def hybrid_context(spark, sf_dir):
    content = F.concat_ws(" | ", "machine_model", "category", "work_content")
    found = hybrid.hybrid_search(
        documents_as_records(spark, sf_dir), table(spark, sf_dir, "embeddings"), _QUESTION,
        probe_vector(spark, sf_dir), 10, content, columns=_DOC_COLUMNS)
    return rounded(fusion.pack_context(found, "document_id")).drop("content")


@query(_HYBRID_CONTEXT_SQL)
def hybrid_context_stored(spark, sf_dir):
    """The same from stored indexes: cells, searched exactly, and grams."""
    content = F.concat_ws(" | ", "machine_model", "category", "work_content")
    found = hybrid.hybrid_search(
        documents_as_records(spark, sf_dir), stored_cells(spark, sf_dir), _QUESTION, probe_vector(spark, sf_dir),
        10, content, columns=_DOC_COLUMNS, index=stored_grams(spark, sf_dir))
    return rounded(fusion.pack_context(found, "document_id")).drop("content")


_TURN_ID = "conv_id || '-' || turn"
_TURNS = f"(SELECT {_TURN_ID} AS turn_id, text FROM conversations)"
_TURN_TEXT = "the that with from"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.col("text"))


def turn_hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    found = tfidf.tfidf_search(turns(spark, sf_dir), _TURN_TEXT, k, "turn_id")
    return (fusion.with_records(found.withColumnRenamed("doc_id", "id"), turns(spark, sf_dir),
                                "id", "turn_id")
            .select("id", "score", F.col("text").alias("content")))


def _turn_hits_sql(k: int) -> str:
    return f"""{tfidf_sql(_TURN_TEXT, _TURNS, "turn_id")},
hit AS (SELECT doc_id AS id, score, text AS content FROM score
        JOIN {_TURNS} ON doc_id = turn_id WHERE score > 0
        ORDER BY round(score, 12) DESC, doc_id LIMIT {k})"""


@query(f"""WITH {_turn_hits_sql(15)} SELECT id, round(score, 6) AS score, content FROM hit""")
def search_with_records(spark, sf_dir):
    return rounded(turn_hits(spark, sf_dir, 15))


@query(f"""WITH {_turn_hits_sql(30)}, {_CONTEXT_SQL.format(key="id")}""")
def context_budget(spark, sf_dir):
    return rounded(fusion.pack_context(turn_hits(spark, sf_dir, 30))).drop("content")


@query(f"""WITH {_turn_hits_sql(5)}
SELECT id, round(score, 6) AS score, '関連情報: ' || content AS context_text FROM hit""")
def context_first_hits(spark, sf_dir):
    return rounded(fusion.first_hits(turn_hits(spark, sf_dir, 10))).drop("content")


# --- fallback search ----------------------------------------------------------------------------

_SUMMARY_SQL = """
s AS (SELECT unnest(['all', 'machine_model', 'work_content']) AS section,
             unnest([NULL, machine_model, work_content]) AS value FROM found),
c AS (SELECT section, value, count(*) AS cases FROM s WHERE section = 'all' OR value IS NOT NULL
      GROUP BY ALL),
summary AS (SELECT * FROM (SELECT section, value, cases, CAST(row_number() OVER (
    PARTITION BY section ORDER BY cases DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 3)
"""
_FOUND_SQL = """
, u AS (SELECT case_no, work_content, machine_model, NULL AS parts_name, l_orderkey, l_linenumber,
          l_partkey, l_suppkey, 0 AS part FROM cases
        UNION ALL SELECT case_no, work_content, machine_model, parts_name, l_orderkey, l_linenumber,
          l_partkey, l_suppkey, 1 FROM clean),
r AS (SELECT *,
    CASE WHEN coalesce(contains(lower(work_content), 'red'), false) THEN 1.0 ELSE 0 END
    + CASE WHEN coalesce(contains(lower(work_content), 'brand#2'), false) THEN 1.0 ELSE 0 END
    + CASE WHEN coalesce(contains(lower(parts_name), 'red'), false) THEN 1.0 ELSE 0 END
    + CASE WHEN coalesce(contains(lower(parts_name), 'brand#2'), false) THEN 1.0 ELSE 0 END
    + CASE WHEN coalesce(contains(lower(machine_model), 'red'), false) THEN 0.5 ELSE 0 END
    + CASE WHEN coalesce(contains(lower(machine_model), 'brand#2'), false) THEN 0.5 ELSE 0 END
    AS relevance FROM u),
found AS (SELECT * FROM r WHERE relevance > 0)
"""


def both_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part_rows = clean(spark, sf_dir, "case_no", *ORDER, "work_content", "machine_model",
                      "parts_name")
    case_rows, _ = facts.split_facts(part_rows, ORDER)
    return (case_rows.withColumn("part", F.lit(0)), part_rows.withColumn("part", F.lit(1)))


FALLBACK_TEXT = "Red brand#2"
_TIES = [*KEY, "part"]


@query(on_records(f"""{_FOUND_SQL}
SELECT case_no, work_content, machine_model, part, CAST(relevance AS DOUBLE) AS relevance,
  l_linenumber FROM found
ORDER BY relevance DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, part LIMIT 50"""))
def fallback_union_search(spark, sf_dir):
    _, shown = search.fallback_search(*both_facts(spark, sf_dir), FALLBACK_TEXT, _TIES)
    return shown.select("case_no", "work_content", "machine_model", "part", "relevance",
                        "l_linenumber")


@query(on_records(f"{_FOUND_SQL}, {_SUMMARY_SQL} SELECT * FROM summary"))
def result_summary(spark, sf_dir):
    summary, _ = search.fallback_search(*both_facts(spark, sf_dir), FALLBACK_TEXT, _TIES)
    return summary


@query(on_records(f"""{_FOUND_SQL}, {_SUMMARY_SQL}
SELECT '「{FALLBACK_TEXT}」に関連するデータが' || (SELECT cases FROM summary WHERE section = 'all')
  || '件見つかりました。' || chr(10) || '主な機種: ' || (SELECT string_agg(value || '(' || cases
  || '件)', '、' ORDER BY rank) FROM summary WHERE section = 'machine_model') || chr(10)
  || '主な作業内容: ' || (SELECT string_agg(value || '(' || cases || '件)', '、' ORDER BY rank)
  FROM summary WHERE section = 'work_content') AS text"""))
def summary_text(spark, sf_dir):
    summary, _ = search.fallback_search(*both_facts(spark, sf_dir), FALLBACK_TEXT, _TIES)
    return search.summary_text(summary, FALLBACK_TEXT)


# --- cells: parsing, codes, composed texts ------------------------------------------------------

@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_returnflag
  WHEN 'A' THEN CAST(l_quantity AS BIGINT) * 30 WHEN 'R' THEN CAST(l_quantity AS BIGINT)
  ELSE CASE WHEN l_linestatus = 'F' THEN l_linenumber END END AS DOUBLE) AS days FROM lineitem""")
def duration_days(spark, sf_dir):
    whole = F.col("l_quantity").cast("bigint").cast("string")
    text = (F.when(F.col("l_returnflag") == "A", F.concat(whole, F.lit("カ月3日")))
            .when(F.col("l_returnflag") == "R", F.concat(F.lit("約"), whole, F.lit("日")))
            .when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("string"))
            .otherwise("不明"))
    return table(spark, sf_dir, "lineitem").select(*KEY, values.duration_days(text).alias("days"))


@query("""
SELECT o_orderpriority, nullif(nullif(o_orderstatus, 'P'), 'F') AS status, count(*) AS cases
FROM orders GROUP BY ALL""")
def sentinel_nulls(spark, sf_dir):
    status = F.col("o_orderstatus")
    marked = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(
        status == "P", "« NULL »").when(status == "F", "  ").otherwise(status).alias("status"))
    return (sentinels_to_null(marked).groupBy("o_orderpriority", "status")
            .agg(F.count("*").alias("cases")))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS day,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders""")
def parse_safe(spark, sf_dir):
    priority, day = F.col("o_orderpriority"), F.col("o_orderdate")
    month_first = F.col("o_orderkey") % 3 == 0
    month_name = F.col("o_orderkey") % 3 == 1
    written = (F.when((priority == "1-URGENT") & month_first, F.date_format(day, "M/d/yyyy"))
               .when((priority == "2-HIGH") & month_first, F.date_format(day, "dd-MMM-yyyy"))
               .when((priority == "3-MEDIUM") & month_first, F.date_format(day, "MMM d, yyyy"))
               .when((priority == "3-MEDIUM") & month_name, F.date_format(day, "MMMM d, yyyy HH:mm"))
               .when(priority == "1-URGENT", F.date_format(day, "yyyy/M/d"))
               .when(priority == "2-HIGH", F.date_format(day, "yyyy年M月d日"))
               .when(priority == "3-MEDIUM", F.date_format(day, "yyyyMMdd"))
               .when(priority == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
               .otherwise(F.concat(F.lit("2024-13-"), F.date_format(day, "dd"))))
    price = F.col("o_totalprice").cast("string")
    number = (F.when(F.col("o_orderstatus") == "P", F.concat(price, F.lit("d")))
              .when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), price, F.lit(" ")))
              .otherwise(price))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", values.to_timestamp(written).alias("day"),
        values.to_number(number).alias("price"))


@query(r"""
SELECT doc_id, coalesce(nullif(regexp_extract(text, '\d{3}-\d{4}'), ''),
  nullif(regexp_extract(source, '\d+'), '')) AS phone_or_source FROM documents""")
def extract_code(spark, sf_dir):
    pattern = r"\d{3}-\d{4}"
    return documents(spark, sf_dir).select("doc_id", F.coalesce(
        values.extract_code([F.col("text")], pattern),
        values.extract_code([F.col("source")], r"\d+")).alias("phone_or_source"))


_RECORD_INPUTS = ["machine_model", "series", "category", "department", "work_content",
                  "malfunction_content", "parts_name", "parts_code", "hour_meter", "work_hours",
                  "work_note"]


def _text_sql(labels: dict[str, str], blank_is_null: bool = False) -> str:
    def part(name: str, label: str) -> str:
        cell = f"nullif(CAST({name} AS VARCHAR), '')" if blank_is_null else name
        unit = fields.HOUR_UNIT if name in fields.NUMERIC_RECORD_COLUMNS else ""
        return f"'{label}: ' || {cell} || '{unit}'"

    return "concat_ws(' | ', " + ", ".join(part(n, lb) for n, lb in labels.items()) + ")"


@query(on_records(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_text_sql(fields.RECORD_LABELS)} AS content
FROM clean"""))
def document_text(spark, sf_dir):
    df = derive(lines(spark, sf_dir, *KEY, *_RECORD_INPUTS, spread=True))
    return df.filter(has_any(fields.RECORD_LABELS)).select(*KEY, record_text().alias("content"))


@query(on_records(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_text_sql(fields.LIGHT_LABELS)} AS content,
  {_text_sql(fields.RECORD_SNIPPET_LABELS, True)} AS snippet,
  {_text_sql(fields.LIGHT_SNIPPET_LABELS, True)} AS short_snippet FROM clean"""))
def snippets(spark, sf_dir):
    df = lines(spark, sf_dir, *KEY, "machine_model", "work_content", "malfunction_content",
               "parts_name")
    return df.select(*KEY, light_text().alias("content"), record_snippet().alias("snippet"),
                     light_snippet().alias("short_snippet"))


@query("""
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS metadata FROM events""")
def metadata_json_roundtrip(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", "event_type",
                         F.from_json("props", "k bigint")["k"].alias("k"),
                         metadata_json(["event_type", "user_id"]).alias("metadata"))


@query(r"""
SELECT doc_id, trim(regexp_replace(text, '[\s\x{0B}\x{A0}\x{3000}]+', ' ', 'g')) AS text
FROM documents""")
def normalize_documents(spark, sf_dir):
    # the given texts hold no compatibility characters, so full-width copies must come back as they
    ascii_text = "".join(map(chr, range(0x21, 0x7F)))
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return documents(spark, sf_dir).select(
        "doc_id", normalize_text(F.translate("text", ascii_text + " ", wide + "　")).alias("text"))


@query(f"""WITH {fuzzy_names_sql(FUZZY_NEEDLE, "SELECT p_name AS name FROM part")}
SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT name FROM near)""")
def fuzzy_parts(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.filter(fuzzy_match(F.col("p_name"), FUZZY_NEEDLE)).select("p_partkey", "p_name")


@query()
def fuzzy_documents(spark, sf_dir):
    df = documents(spark, sf_dir)
    return df.filter(fuzzy_match(F.col("text"), "heoron eratch therin bles")).select("doc_id")


@query()
def chunk_texts(spark, sf_dir):
    return chunk_documents(documents(spark, sf_dir).select("doc_id", "text"), "text")


@query("""
SELECT doc_id, true AS fits, true AS from_text, true AS begins, true AS ends, true AS covers
FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def chunk_rules(spark, sf_dir):
    """What holds for the chunks of every text with more than blanks: they fit, are parts of the text,
    begin and end it, and leave out blanks only."""
    rows = documents(spark, sf_dir).select("doc_id", "text", F.trim("text", F.lit(BLANKS)).alias("whole"))
    count = F.length(F.translate("whole", BLANKS, ""))
    return (chunk_documents(rows, "text").groupBy("doc_id").agg(
        F.bool_and(F.length("content") <= fields.CHUNK_SIZE).alias("fits"),
        F.bool_and(F.contains("whole", "content")).alias("from_text"),
        F.bool_and((F.col("chunk_index") > 0) | F.startswith("whole", "content")).alias("begins"),
        F.max_by(F.endswith("whole", "content"), "chunk_index").alias("ends"),
        (F.sum(F.length(F.translate("content", BLANKS, ""))) >= F.max(count)).alias("covers")))


# --- whole ingest steps -----------------------------------------------------------------------

def write_sheets(spark: SparkSession, sf_dir: str) -> list[str]:
    """The orders as two workbooks of several sheets, with headings and column orders of their own."""
    rows, root = table(spark, sf_dir, "orders"), scratch_path(spark, sf_dir, "sheets")
    finished = rows.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("整備案件NO"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("« NULL »").alias(" 機種名"),
        F.col("o_totalprice").alias("部品数量"), F.col("o_orderdate").alias("売上日"))
    others = rows.filter("o_orderstatus <> 'F'").select(
        F.col("o_orderdate").alias("売上日"), F.col("o_orderkey").alias("整備案件NO"),
        F.concat(F.lit('"a, b" '), "o_orderstatus").alias("作業内容"), F.col("o_custkey").alias("備考"))
    for name, sheets in (("book_1", finished), ("book_2", others)):
        (sheets.repartition(max(4, spark.sparkContext.defaultParallelism), "整備案件NO").write.option("header", True).option("escape", '"')
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
         .csv(f"{root}/{name}"))
    return spark.read.text([f"{root}/book_1", f"{root}/book_2"]).inputFiles()


@query("""
SELECT CASE o_orderstatus WHEN 'F' THEN 'book_1' ELSE 'book_2' END AS workbook, count(*) AS rows,
  sum(o_orderkey)::BIGINT AS keys,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '5-LOW') AS models,
  round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS quantity,
  min(o_orderdate)::TIMESTAMP AS first_date, max(CASE WHEN o_orderstatus <> 'F' THEN '"a, b" ' || o_orderstatus END) AS work,
  (count(*) FILTER (o_orderstatus <> 'F')) AS notes
FROM orders GROUP BY 1""")
def sheet_ingest(spark, sf_dir):
    """Sheets written and read back: headers, names, provenance, union and null markers."""
    raw = read_exports(spark, write_sheets(spark, sf_dir))
    kept = raw.select(F.col(FILE_HEADING).alias("workbook"), F.col("整備案件NO").cast("bigint").alias("key"),
                      F.col("機種名").alias("model"), values.to_number(F.col("部品数量")).alias("quantity"),
                      values.to_timestamp(F.col("売上日")).alias("date"), F.col("作業内容").alias("work"),
                      F.col("備考").alias("note"))
    return kept.groupBy("workbook").agg(
        F.count("*").alias("rows"), F.sum("key").alias("keys"), F.count("model").alias("models"),
        F.round(F.sum("quantity"), 2).alias("quantity"), F.min("date").alias("first_date"),
        F.max("work").alias("work"), F.count("note").alias("notes"))


@query(on_records("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(case_no AS VARCHAR) AS case_no,
  machine_model, category, nullif(malfunction_content, '') AS malfunction_content, sales_date,
  work_date, started_date, hour_meter, work_hours, parts_qty, base_date, year, month, week,
  hour_bin, bulletin_no, CAST(l_linenumber * 30 AS DOUBLE) AS elapsed_days, malfunction
FROM clean"""))
def clean_records(spark, sf_dir):
    rows = lines(spark, sf_dir, *ORDER, "case_no", "machine_model", "category",
                 "malfunction_content", *DATES, "hour_meter", "work_hours", "parts_qty",
                 "work_content", "work_note", spread=True)
    cell = lambda name: F.col(name).cast("string")      # noqa: E731
    marker = F.lit("« NULL »")
    raw = rows.select(
        *ORDER, F.coalesce(cell("case_no"), marker).alias("整備案件NO"),
        F.translate("machine_model", "Brand#0123456789", "Ｂｒａｎｄ＃０１２３４５６７８９").alias("機種名"),
        F.coalesce("category", F.lit("  ")).alias("カテゴリ"),
        F.when(F.col("malfunction_content") == "", " ").otherwise(
            F.concat(F.lit("\t"), F.regexp_replace("malfunction_content", " ", "　\n"), F.lit("　")))
        .alias("不具合内容"),
        F.coalesce(F.date_format("sales_date", "yyyy/M/d"), marker).alias("売上日"),
        F.coalesce(F.date_format("work_date", "yyyy年M月d日"), F.lit("n/a")).alias("作業終了日"),
        F.date_format("started_date", "yyyyMMdd").alias("作業開始日"),
        F.coalesce(cell("hour_meter"), F.lit("不明")).alias("アワメータ_HR"),
        F.concat(F.lit(" "), cell("work_hours")).alias("作業時間"),
        cell("parts_qty").alias("部品数量"), F.col("work_content").alias("作業内容"),
        F.col("work_note").alias("作業明細備考"),
        F.concat(cell("l_linenumber"), F.lit("カ月")).alias("経過日数"))
    out = normalize_records(sentinels_to_null(raw))
    return out.select(*KEY, "case_no", "machine_model", "category", "malfunction_content",
                      "sales_date", "work_date", "started_date", "hour_meter", "work_hours",
                      "parts_qty", "base_date", "year", "month", "week", "hour_bin", "bulletin_no",
                      "elapsed_days", "malfunction")


@query("""
SELECT o_orderkey AS case_no, o_orderpriority AS category, o_orderdate AS work_date,
  NULL::VARCHAR AS machine_model, NULL::VARCHAR AS series, NULL::VARCHAR AS department,
  NULL::VARCHAR AS work_content, NULL::VARCHAR AS malfunction_content, NULL::VARCHAR AS parts_name,
  NULL::VARCHAR AS parts_code, o_totalprice AS work_hours, NULL::DOUBLE AS hour_meter,
  NULL::VARCHAR AS bulletin_no FROM orders""")
def standard_table(spark, sf_dir):
    return standard_records(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("整備案件NO"), F.col("o_orderpriority").alias("カテゴリ"),
        F.col("o_orderdate").alias("作業終了日"), F.col("o_totalprice").alias("作業時間"),
        F.col("o_custkey").alias("無関係")))


@query("""
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
  AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def record_ids(spark, sf_dir):
    return number_rows(lines(spark, sf_dir, *ORDER), ORDER).drop("l_extendedprice")


@query("""
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::BIGINT AS suppkey
FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, s_suppkey FROM supplier""")
def sheet_union(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"))
    return search.combined_facts(customers, suppliers)
