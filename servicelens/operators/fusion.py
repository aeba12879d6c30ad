"""Combine scored hits of several searches. All inputs are top-k lists of (id, score, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servicelens import fields

_BROADCAST_IDS = 100_000


def top_k(hits: DataFrame, k: int, *tie_break: str) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), *tie_break).limit(k)


def _carried(*sides: DataFrame) -> list[str]:
    """Columns beside id and score that all sides have, such as content and metadata."""
    return [c for c in sides[0].columns
            if c not in ("id", "score") and all(c in s.columns for s in sides)]


def fuse_union(keyword: DataFrame, semantic: DataFrame, k: int,
               semantic_weight: float = fields.SEMANTIC_WEIGHT) -> DataFrame:
    """Weighted union under separate id spaces: the same record may appear once per side.

    (document_id, score) and the columns that both sides carry.
    """
    carried = _carried(keyword, semantic)
    sides = [("db_", keyword, 1 - semantic_weight), ("vec_", semantic, semantic_weight)]
    parts = [hits.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("document_id"),
                         (F.col("score") * weight).alias("score"), *carried)
             for prefix, hits, weight in sides]
    return top_k(parts[0].unionByName(parts[1]), k, "document_id")


def fuse_by_record(keyword: DataFrame, semantic: DataFrame, k: int,
                   semantic_weight: float = fields.SEMANTIC_WEIGHT) -> DataFrame:
    """Scores of the same record are added: full outer join of the two top lists on the id.

    (id, score) and the columns that both sides carry, from the keyword side where it has them.
    """
    carried = _carried(keyword, semantic)

    def weighted(hits: DataFrame, weight: float, name: str) -> DataFrame:
        return hits.select("id", (F.col("score") * weight).alias(name),
                           *(F.col(c).alias(f"{name}_{c}") for c in carried))

    both = weighted(keyword, 1 - semantic_weight, "_k").join(
        weighted(semantic, semantic_weight, "_s"), "id", "full_outer")
    total = F.coalesce("_k", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0))
    return top_k(both.select("id", total.alias("score"),
                             *(F.coalesce(f"_k_{c}", f"_s_{c}").alias(c) for c in carried)), k, "id")


def fuse_exactly(keyword: DataFrame, semantic: DataFrame, k: int,
                 semantic_weight: float = fields.SEMANTIC_WEIGHT, first: int | None = None) -> DataFrame:
    """The k records with the highest sums over all hits of both sides: (id, score).

    Where `fuse_by_record` adds up two cut lists and can miss a record that is just below the cut on both,
    this one goes on until none can be missed (Fagin's threshold algorithm). Each round reads the best
    hits of each side, looks up the other side's scores of their records, and stops when k of the sums
    are above what any record behind both cuts can reach; else the lists get four times as long. The inputs
    are whole hit tables with one row per id and scores of 0 or more.
    """
    weights = (1 - semantic_weight, semantic_weight)
    sides = [hits.select("id", (F.col("score") * w).alias("score")) for hits, w in zip((keyword, semantic), weights)]
    size = first or 2 * k
    while True:
        tops = [top_k(side, size, "id") for side in sides]
        cuts = [top.agg(F.when(F.count("*") >= size, F.min("score")).otherwise(0.0).alias("cut"),
                        (F.count("*") < size).alias("all")).first() for top in tops]
        seen = tops[0].select("id").union(tops[1].select("id")).distinct()
        seen = F.broadcast(seen) if size <= _BROADCAST_IDS else seen
        sums = (sides[0].unionByName(sides[1]).join(seen, "id", "left_semi")
                .groupBy("id").agg(F.sum("score").alias("score")))
        found = top_k(sums, k, "id")
        reach = sum(c["cut"] for c in cuts)
        told = found.agg(F.count("*").alias("rows"), F.min("score").alias("least")).first()
        if all(c["all"] for c in cuts) or told["rows"] >= k and told["least"] > reach:
            return found
        size *= 4


def light_hybrid(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """Best `k // 2` hits of each side in one list; equal scores list semantic hits first.

    Keyword hits all score the same and count in load order. A record found by both sides appears
    twice. Columns that both sides carry are kept.
    """
    half, carried = k // 2, _carried(semantic, keyword)
    sides = [("doc_", 0, top_k(semantic, half, "id")),
             ("struct_", 1, keyword.orderBy("id").limit(half))]
    parts = [hits.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("document_id"),
                         "score", *carried, F.lit(side).alias("_side"), "id")
             for prefix, side, hits in sides]
    return top_k(parts[0].unionByName(parts[1]), k, "_side", "id").drop("_side", "id")


def with_records(hits: DataFrame, records: DataFrame, hit_id: str, record_id: str) -> DataFrame:
    """Look up the records of a top list. The list has at most k rows, so it is broadcast and the
    records are scanned in place."""
    return records.join(F.broadcast(hits), records[record_id] == hits[hit_id])


def pack_context(hits: DataFrame, tie_break: str = "id", max_chars: int = fields.CONTEXT_CHARACTERS) -> DataFrame:
    """The hits whose texts fit the budget, in score order, stopping at the first overflow.

    `hits` is a top list, so the global running sum works on k rows. Each text carries a header line
    with the score; all lengths are positive, so a running sum within the budget is the early stop.
    """
    before, after = fields.CONTEXT_HEADER
    header = F.concat(F.lit(before), F.format_string("%.2f", F.bround("score", 2)), F.lit(after))
    text = F.concat(header, F.col("content"), F.lit("\n"))
    order = Window.orderBy(F.col("score").desc(), tie_break)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return (hits.withColumn("context_text", text)
            .withColumn("position", F.row_number().over(order))
            .withColumn("used_chars", F.sum(F.length("context_text")).over(upto))
            .filter(F.col("used_chars") <= max_chars))


def first_hits(hits: DataFrame, n: int = 5) -> DataFrame:
    """The light form of context packing: the first n hits, each under a fixed label."""
    return top_k(hits, n, "id").withColumn(
        "context_text", F.concat(F.lit(fields.CONTEXT_LABEL), F.col("content")))


def context(packed: DataFrame) -> DataFrame:
    """The packed texts in one row, in order."""
    texts = F.array_sort(F.collect_list(F.struct("position", "context_text")))
    return packed.agg(F.array_join(F.transform(texts, lambda t: t["context_text"]), "\n")
                      .alias("context"))
