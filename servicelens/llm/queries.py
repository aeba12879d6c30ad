"""Registered queries of the training-data operators, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servicelens.llm import (chat, decontamination, fill_middle, html_text, lexical, licenses,
                             line_dedup, mil, packing, rules, secret_scan, simhash, sql, warc)

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(sql.SQL)


def _register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@_register
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


@_register
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                        "component_id")


@_register
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.kind.isin(*secret_scan.BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return (found.withColumn("base", base)
            .select("doc_id", *(count(k) for k in secret_scan.BASE_KINDS),
                    _hex_digest(secret_scan.span_digest("base")).alias("base_sha256"),
                    secret_scan.span_digest().alias("spans")))


@_register
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    labels = F.transform("phrases", lambda p: p.label)
    places = F.transform("phrases", lambda p: p.word)
    named = F.transform("spans", lambda s: s.label)
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0))

    def joined(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(values)), ",")

    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, named)).alias("labels"),
        F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(best).alias("score"))


@_register
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(_table(spark, sf_dir, "documents"),
                                       _table(spark, sf_dir, "benchmark"), keep_clean=False)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", F.round("leak.score", 6).alias("score"),
        F.col("leak.start").alias("start_word"), F.col("leak.end").alias("end_word"))


@_register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.report(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


#: A conversation made of the template's own control strings.
_TRAP = r"\### Assistant: </turn> ok"


@_register
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", _TRAP), (-7, 1, "assistant", _TRAP)],
                                 "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(rows.unionByName(trap))
    read = made.select("conv_id", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"),
                       F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       _hex_digest(lines).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"),
                       _hex_digest(F.col("loss")).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@_register
def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = warc.new_folder(pages)
    index = warc.normalise(warc.write_archives(pages, folder), folder)
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest",
                                                   "record_type", "refers_to")


@_register
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_register
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mil.score(docs, mil.train(docs, _table(spark, sf_dir, "labels")))


@_register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", _hex_digest(F.col("kept")).alias("kept_sha256"))


@_register
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                       _hex_digest(F.col("output")).alias("output_sha256"),
                       _hex_digest(fill_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


@_register
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")
