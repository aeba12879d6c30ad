"""The driver's tables seen as repair records.

The repair exports themselves are not available, so the registered queries run on this view of the
given tables. A record is a line item; its columns come from the line, its order, part, customer and
nation. Only the tables that the requested columns need are joined. Some cells are turned into
nulls, blanks and inspection words so that the rules about them are exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from servicelens.sources.tables import spread_table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_LINE, _ORDERS, _PART, _CUSTOMER, _NATION = "lineitem", "orders", "part", "customer", "nation"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. They do not change, so each schema is read once and not by a job per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def spread_partitions(spark: SparkSession) -> int | None:
    """The session's `servicelens.spread.partitions`, for tables known to be one unsplittable file."""
    asked = spark.conf.get("servicelens.spread.partitions", None)
    return int(asked) if asked else None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(table(spark, sf_dir, "documents"), "doc_id", spread_partitions(spark))


def _columns() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Record column -> (tables it needs, expression)."""
    c, text = F.col, lambda name: F.col(name).cast("string")
    status, priority, tax = c("o_orderstatus"), c("o_orderpriority"), c("l_tax")
    return {
        **{name: ((_LINE,), c(name)) for name in ORDER},
        "case_no": ((_LINE,), F.when(
            (c("l_linenumber") == 7) & (c("l_quantity") >= 48), None).otherwise(c("l_orderkey"))),
        "kind": ((_LINE,), c("l_linestatus")),
        "warranty_class": ((_LINE,), c("l_returnflag")),
        "sales_date": ((_LINE,), F.when(c("l_returnflag") != "N", c("l_shipdate"))),
        "work_date": ((_LINE,), F.when(
            c("l_linestatus") != "O", c("l_shipdate") + F.expr("interval 3 days"))),
        "hour_meter": ((_LINE,), F.when(c("l_quantity") != 13, c("l_quantity") * 50)),
        "work_hours": ((_LINE,), F.when(c("l_quantity") != 1, c("l_quantity"))),
        "parts_qty": ((_LINE,), c("l_quantity")),
        "parts_code": ((_LINE,), text("l_partkey")),
        "started_date": ((_ORDERS,), c("o_orderdate")),
        "service_class": ((_ORDERS,), F.when(priority == "5-LOW", "定期点検")
                          .when(priority == "4-NOT SPECIFIED", "特自検")
                          .when(priority != "3-MEDIUM", priority)),
        "category": ((_ORDERS, _PART), F.when(status == "O", "定期点検")
                     .when(status != "P", c("p_type"))),
        "malfunction_content": ((_LINE, _PART), F.when(tax < 0.005, "")
                                .when(tax < 0.035, "法定検査")
                                .when(tax > 0.065, F.concat(c("p_name"), F.lit(" 漏れ")))),
        "machine_model": ((_PART,), F.nullif(c("p_brand"), F.lit("Brand#13"))),
        "series": ((_PART,), c("p_type")),
        "parts_name": ((_PART,), c("p_name")),
        "work_content": ((_PART, _LINE), F.concat(c("p_name"), F.when(
            c("p_size") > 45, F.concat(F.lit(" K-"), text("p_size"), F.lit("-"),
                                       text("l_suppkey"))).otherwise(""))),
        "work_note": ((_PART, _LINE), F.when(c("l_discount") > 0.085, F.concat(
            F.lit("see K-"), text("l_linenumber"), F.lit("-"), text("p_size")))),
        "location": ((_CUSTOMER,), c("c_mktsegment")),
        "department": ((_NATION,), F.nullif(c("n_name"), F.lit("NATION_7"))),
    }


def lines(spark: SparkSession, sf_dir: str, *names: str, spread: bool = False) -> DataFrame:
    """Repair records with the named columns; `spread` is for work that is heavy per row."""
    columns = _columns()
    needed = {t for n in names for t in columns[n][0]}
    df = table(spark, sf_dir, _LINE)
    df = spread_table(df, "l_orderkey", spread_partitions(spark)) if spread else df

    def join(name: str, left: str, right: str) -> None:
        nonlocal df
        other = table(spark, sf_dir, name)
        df = df.join(other, df[left] == other[right])

    if needed & {_ORDERS, _CUSTOMER, _NATION}:
        join(_ORDERS, "l_orderkey", "o_orderkey")
    if needed & {_CUSTOMER, _NATION}:
        join(_CUSTOMER, "o_custkey", "c_custkey")
    if _NATION in needed:
        join(_NATION, "c_nationkey", "n_nationkey")
    if _PART in needed:
        join(_PART, "l_partkey", "p_partkey")
    return df.select(*(columns[n][1].alias(n) for n in names))


def documents_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records with long work texts."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("machine_model"),
        F.col("source").alias("category"), F.col("text").alias("work_content"))


# The same view for the SQL side: `rec`, `clean` with the derived columns, `cases`.
RECORDS_SQL = r"""
rec AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    CASE WHEN l_linenumber = 7 AND l_quantity >= 48 THEN NULL ELSE l_orderkey END AS case_no,
    l_linestatus AS kind, l_returnflag AS warranty_class,
    CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS sales_date,
    CASE WHEN l_linestatus <> 'O' THEN l_shipdate + INTERVAL 3 DAY END AS work_date,
    CASE WHEN l_quantity <> 13 THEN l_quantity * 50 END AS hour_meter,
    CASE WHEN l_quantity <> 1 THEN l_quantity END AS work_hours,
    l_quantity AS parts_qty, CAST(l_partkey AS VARCHAR) AS parts_code,
    o_orderdate AS started_date,
    CASE WHEN o_orderpriority = '5-LOW' THEN '定期点検'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '特自検'
         WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS service_class,
    CASE WHEN o_orderstatus = 'O' THEN '定期点検'
         WHEN o_orderstatus <> 'P' THEN p_type END AS category,
    CASE WHEN l_tax < 0.005 THEN '' WHEN l_tax < 0.035 THEN '法定検査'
         WHEN l_tax > 0.065 THEN p_name || ' 漏れ' END AS malfunction_content,
    nullif(p_brand, 'Brand#13') AS machine_model, p_type AS series, p_name AS parts_name,
    p_name || CASE WHEN p_size > 45 THEN ' K-' || p_size || '-' || l_suppkey ELSE '' END
      AS work_content,
    CASE WHEN l_discount > 0.085 THEN 'see K-' || l_linenumber || '-' || p_size END AS work_note,
    c_mktsegment AS location, nullif(n_name, 'NATION_7') AS department
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
dated AS (SELECT *, coalesce(sales_date, work_date, started_date) AS base_date FROM rec),
clean AS (
  SELECT *, CAST(year(base_date) AS INTEGER) AS year, CAST(month(base_date) AS INTEGER) AS month,
    CAST(week(base_date) AS INTEGER) AS week,
    CASE WHEN hour_meter IS NULL THEN '不明' WHEN hour_meter < 250 THEN '0-250'
         WHEN hour_meter < 500 THEN '250-500' WHEN hour_meter < 1000 THEN '500-1000'
         WHEN hour_meter < 2000 THEN '1000-2000' ELSE '2000+' END AS hour_bin,
    CAST(coalesce(category <> '' AND NOT regexp_matches(category, '点検|検査'), false)
      OR coalesce(malfunction_content <> ''
                  AND NOT regexp_matches(malfunction_content, '点検|検査'), false)
      AS INTEGER) AS malfunction,
    coalesce(nullif(regexp_extract(work_content, 'K-\d+-\d+'), ''),
             nullif(regexp_extract(work_note, 'K-\d+-\d+'), '')) AS bulletin_no
  FROM dated),
cases AS (
  SELECT * EXCLUDE (rn, parts_code, parts_name, parts_qty) FROM (
    SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY l_orderkey DESC, l_linenumber DESC,
      l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM clean)
  WHERE rn = 1)
"""

DOCUMENT_RECORDS_SQL = """
doc AS (SELECT doc_id AS id, lang AS machine_model, source AS category, text AS work_content
        FROM documents)
"""
