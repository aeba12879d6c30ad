"""A corpus pipeline of five stages over `documents`.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's documents:

* quality rules: rejected documents go;
* SimHash near-dedup: of each group of near duplicates one row stays, that with the smallest id;
* benchmark decontamination: documents that hold a test item go;
* secret scan: every secret in a text is replaced by a mark (and `n_chars` follows);
* best-fit packing: the texts become token pieces placed in sequences.

All but the last return the columns of `documents`. Null ids: such documents are kept by the dedup,
as nothing names them; documents equal in id and text become one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens.llm import decontamination, packing, rules, secret_scan, simhash
from servicelens.llm.common import durable, only, shared_folder, text_key
from servicelens.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.judge(only(docs, *COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: the smallest id, and of its texts the one with the least key."""
    found = durable(simhash.near_duplicates(docs, keyed=True))
    first = F.col("doc_id") == F.col("component_id")
    others = found.where(~first).select("doc_id", "text_key")
    heads = found.where(first).select("root", "doc_id", "text_key").distinct()
    heads = heads.withColumn("kept_key", F.min("text_key").over(Window.partitionBy("root")))
    twins = heads.where(F.col("text_key") != F.col("kept_key")).select("doc_id", "text_key")
    gone = others.union(twins).distinct().toDF("gone_id", "gone_key")
    rows = only(docs, *COLUMNS)
    return (rows.join(gone, (rows.doc_id == gone.gone_id) & (text_key() == F.col("gone_key")), "left_anti")
            .dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontamination.find_leaks(only(docs, *COLUMNS), benchmark)
    return judged.where(F.size("leaks") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.find_secrets(only(docs, *COLUMNS))
    length = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length.cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack),
]

#: Fingerprints and alignments have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
