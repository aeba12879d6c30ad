import codecs
from datetime import datetime

import pytest
from conftest import cells
from pyspark.sql import functions as F

from servicelens.operators.clean import normalize_records
from servicelens.sources import exports, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_header_choice():
    blank = [None] * 9 + ["報告書"]
    assert exports.pick_header([blank, ["a", "b", "c"]]).header_row == 1
    assert exports.pick_header([blank, ["a", "b"]]).header_row == 0       # 80 % of the width is blank
    assert exports.pick_header([["a"], ["b", "c"]], 6).header_row == 1
    assert exports.pick_header([["a", None], ["1", "2"]]).names == ("a", "Unnamed: 1")
    assert exports.pick_header([blank, blank]).header_row == 0
    assert exports.pick_header([blank]).header_row == 0


def test_clean_names():
    assert exports.clean_names(["a", "a", " b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_sentinels(rows):
    df = rows("i int, v string", (1, "« NULL »"), (2, ""), (3, " "), (4, "  "), (5, "   "),
              (6, "x"))
    assert cells(exports.sentinels_to_null(df).orderBy("i"), "v") == [
        (None,), (None,), (None,), (None,), ("   ",), ("x",)]


@pytest.fixture()
def workbooks(tmp_path):
    return [
        write(tmp_path / "前期 1+6" / "修理.csv",
              "整備案件NO,機種名 ,部品数量\nA1,ＫＸ－０８０,2\nA2,« NULL »,\"3\"\n,U-30,\n"),
        write(tmp_path / "後期" / "修理.csv", "整備案件NO,機種名 ,部品数量\nB1,\"U\"\"15\",4\n"),
        write(tmp_path / "後期" / "表.csv",
              ",,,,,報告書\n整備案件NO,作業内容,売上日,x.1,x.1,備考\nB2,K-1-2 交換,2024/3/1,p,q,r\n"),
        str(tmp_path / "無い.csv"),
        write(tmp_path / "後期" / "空.csv", ""),
    ]


def test_read_exports(spark, workbooks):
    df = exports.read_exports(spark, workbooks)
    assert set(df.columns) == {"整備案件NO", "機種名", "部品数量", "作業内容", "売上日", "x.1", "x.1_1",
                               "備考", "ファイル名", "シート名", *exports.LOAD_ORDER}
    got = cells(df.orderBy(*exports.LOAD_ORDER),
                "整備案件NO", "機種名", "部品数量", "`x.1`", "`x.1_1`", "ファイル名", "シート名")
    assert got == [
        ("A1", "ＫＸ－０８０", "2", None, None, "前期 1+6", "修理"),
        ("A2", None, "3", None, None, "前期 1+6", "修理"),
        (None, "U-30", None, None, None, "前期 1+6", "修理"),
        ("B1", 'U"15', "4", None, None, "後期", "修理"),
        ("B2", None, None, "p", "q", "後期", "表")]


def test_read_exports_sheet_allow_list_and_nothing_readable(spark, workbooks):
    only = exports.read_exports(spark, workbooks, sheets=["表"])
    assert cells(only, "整備案件NO") == [("B2",)]
    assert exports.read_exports(spark, workbooks[3:]).columns == []


def test_files_of_one_layout_share_a_scan(spark, tmp_path):
    paths = [write(tmp_path / f"w{i}" / "s.csv", f"a,b\n{i},x\n") for i in range(7)]
    df = exports.read_exports(spark, paths)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    assert [r[0] for r in df.orderBy(*exports.LOAD_ORDER).collect()] == [str(i) for i in range(7)]


def test_width_is_that_of_the_whole_sheet(spark, tmp_path):
    late = write(tmp_path / "w" / "late.csv", "Report\n整備案件NO,機種名,作業時間\nA1,U-30,2\n")
    df = exports.read_exports(spark, [late])
    assert cells(df.orderBy(*exports.LOAD_ORDER), "Report", "`Unnamed: 1`", "`Unnamed: 2`") == [
        ("整備案件NO", "機種名", "作業時間"), ("A1", "U-30", "2")]
    title = write(tmp_path / "w" / "title.csv", "Report\na,b,c,d,e,f\n1,2,3,4,5,6\n\"x, \"\"y\",2\n")
    df = exports.read_exports(spark, [title])
    assert cells(df.orderBy(*exports.LOAD_ORDER), "a", "b", "f") == [("1", "2", "6"), ('x, "y', "2", None)]


def test_only_the_first_record_equal_to_the_header_is_the_header(spark, tmp_path):
    path = write(tmp_path / "w" / "s.csv", ",,,,,t\na,b,c,d,e,f\n1,,,,,\na,b,c,d,e,f\n2,,,,,\n")
    df = exports.read_exports(spark, [path])
    assert cells(df.orderBy(*exports.LOAD_ORDER), "a") == [("1",), ("a",), ("2",)]


def test_records_over_several_lines(spark, tmp_path):
    path = write(tmp_path / "w" / "s.csv", 'a,b\n"1\n2",x\n3,y,z\n')
    df = exports.read_exports(spark, [path], multi_line=True)
    assert cells(df.orderBy(*exports.LOAD_ORDER), "a", "b", "`Unnamed: 2`") == [("1\n2", "x", None), ("3", "y", "z")]


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    paths = [write(tmp_path / f"v{i}" / "s.csv", f"a,b\n{i},x\n") for i in range(12)]
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 12):
        spark.sparkContext.setJobGroup(f"layouts{n}", "")
        assert exports.find_layouts(spark, paths[:n]).count() == n
        jobs.append(len(tracker.getJobIdsForGroup(f"layouts{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_records_are_not_shuffled_by_file(spark, workbooks):
    """A file's records would all meet in one task, however large the file."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exports.read_exports(spark, workbooks[:2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_ingest_to_clean_records(spark, workbooks):
    out = normalize_records(exports.read_exports(spark, workbooks))
    row = {r["case_no"]: r for r in out.collect()}
    assert row["A1"]["machine_model"] == "KX-080" and row["A1"]["parts_qty"] == 2.0
    assert row["B2"]["bulletin_no"] == "K-1-2"
    assert row["B2"]["base_date"] == datetime(2024, 3, 1) and row["B2"]["month"] == 3
    assert row["A1"]["malfunction"] == 0 and row["A1"]["base_date"] is None


def test_standard_records(rows):
    df = rows("`整備案件NO` string, `作業時間` double, `他` int", ("A", 1.5, 2))
    out = tables.standard_records(df)
    assert len(out.columns) == 13 and dict(out.dtypes)["work_date"] == "timestamp_ntz"
    assert cells(out, "case_no", "work_hours", "series") == [("A", 1.5, None)]


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"),
                                  F.lit("same").alias("hot"))
    out = tables.number_rows(df, ["hot", "k"], partitions=7)
    assert out.columns == ["k", "hot", "id"]
    assert cells(out.orderBy("id"), "id", "k") == [(i + 1, i) for i in range(1000)]


def test_number_rows_of_nothing(spark):
    assert tables.number_rows(spark.range(0), ["id"], "n", 3).count() == 0


def test_store_replaces_the_table(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(rows("a int, y int", (1, 2023), (2, 2024)), path, ["y"])
    tables.replace_table(rows("a int, y int", (3, 2024)), path, ["y"])
    assert cells(spark.read.parquet(path), "a", "y") == [(3, 2024)]


def test_csv_export_has_header_and_mark(spark, rows, tmp_path):
    path = tmp_path / "out"
    df = rows("`整備案件NO` string, d timestamp_ntz", ('A"1', datetime(2024, 1, 2)), (None, None))
    tables.write_csv(df.coalesce(1), str(path))
    (part,) = path.glob("part-*.csv")
    data = part.read_bytes()
    assert data.startswith(codecs.BOM_UTF8)
    assert data.decode("utf-8-sig").splitlines() == [
        "整備案件NO,d", '"A""1",2024-01-02 00:00:00', ","]


def test_spread_only_when_asked(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert tables.spread_table(spark.read.parquet(path), "id", 4).rdd.getNumPartitions() == 4
    plan = tables.spread_table(spark.read.parquet(path), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
