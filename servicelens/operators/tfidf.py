"""TF-IDF weights and cosine search over a document table, as joins and aggregates.

The weights are a long table of (document, term) rows, never one map per document; the stored index holds
counts, as lists of a term's documents in chunks of bounded size. Weight of a term in a document: count/length * ln(N / (df + 1)); it is 0 or negative for terms in nearly all documents.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens.functions.batches import sliced
from servicelens.functions.text import tokens
from servicelens.operators.skew import join_counted_key
from servicelens.session import ensure_checkpoint_dir

LISTED = 2_000_000                  # postings gathered in a task before they become lists
CHUNK_DOCUMENTS = 1 << 13
_STEP = 1 << 10                     # documents that are counted at a time
_CHUNKS_BITS = 20                   # of a chunk's number: chunks of a task
_SUMMED_CHUNKS = 1 << 10            # whose sums a task holds at a time, 16 bytes a document

_BETWEEN = r"[^\p{L}\p{N}_]+"        # what parts the words of `functions.text.tokens`


def _tokenized(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens"))


def _exploded(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per element. A plain explode makes Spark infer a filter on the array's size, which
    would tokenize every text a second time; the outer form does not."""
    return df.select(*keep, F.explode_outer(array).alias("term")).filter("term is not null")


def document_frequency(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, df): the number of documents a term occurs in.

    Repeats are removed inside each row, so the only shuffle is that of the partial counts.
    """
    terms = _exploded(_tokenized(documents, doc_id, text), F.array_distinct("tokens"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, occurrences, documents), from one pass and one shuffle of partial counts.

    Every token counts as an occurrence, and the distinct tokens of a row count as documents.
    """
    def marked(array: Column, occurrences: int, rows: int) -> Column:
        return F.transform(array, lambda t: F.struct(
            t.alias("term"), F.lit(occurrences).alias("occurrences"), F.lit(rows).alias("rows")))

    found = _tokenized(documents, doc_id, text)
    both = F.concat(marked(F.col("tokens"), 1, 0), marked(F.array_distinct("tokens"), 0, 1))
    each = found.select(F.inline_outer(both)).filter("term is not null")
    return each.groupBy("term").agg(F.sum("occurrences").alias("occurrences"),
                                    F.sum("rows").alias("documents"))


def term_counts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf) with tf the term's share of the document's tokens.

    A document is one row, so its terms are counted there, in Arrow batches, and nothing is shuffled.
    The tokens themselves are found by Spark, as everywhere.
    """
    found = _tokenized(documents, doc_id, text)
    schema = T.StructType([found.schema["doc_id"], T.StructField("term", T.StringType()),
                           T.StructField("tf", T.DoubleType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = batch.column("tokens")
            codes = pc.dictionary_encode(lists.flatten())
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(len(codes.dictionary), 1)
            keys = np.repeat(np.arange(len(lengths)), lengths) * width + codes.indices.to_numpy()
            keys, counts = np.unique(keys, return_counts=True)
            rows, terms = keys // width, keys % width
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), codes.dictionary.take(pa.array(terms)),
                 pa.array(counts / lengths[rows])], ["doc_id", "term", "tf"])

    return found.mapInArrow(counted, schema)


def chunk_lists(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, chunk, places, counts, docs): the documents of a chunk that hold a term, by their places there,
    and how often each does.

    A task gathers its documents in chunks, of about `LISTED` postings or `CHUNK_DOCUMENTS` at most, so that
    what is shuffled are lists of small numbers. A term has a list for each chunk that holds it, each document
    is in one chunk, and no two tasks number a chunk alike. A further row of a chunk has the ids of all its
    documents and, as counts, their lengths; its term is a blank and the chunk's number, which is no word.

    A task that is run again after a failure has to meet its rows in the same order, as it does in files.
    """
    low = documents.select(F.col(doc_id).alias("doc_id"), F.lower(F.col(text)).alias("text"))
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("chunk", T.LongType()),
        T.StructField("places", T.ArrayType(T.ShortType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("docs", T.ArrayType(low.schema["doc_id"].dataType))])

    def counted(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The terms of a batch and, of each posting, which of them, the row and the count."""
        pieces = pc.split_pattern_regex(pc.fill_null(batch.column("text"), ""), _BETWEEN)
        words, place = pieces.flatten(), pc.list_parent_indices(pieces).to_numpy()
        held = pc.not_equal(words, "")          # a text that begins or ends between words has blank pieces
        codes = pc.dictionary_encode(words.filter(held))
        place = place[held.to_numpy(zero_copy_only=False)]
        keys = codes.indices.to_numpy().astype(np.int64) * batch.num_rows + place
        keys, counts = np.unique(keys, return_counts=True)
        return (codes.dictionary, (keys // batch.num_rows).astype(np.int32),
                (keys % batch.num_rows).astype(np.int16), counts.astype(np.int32))

    def lists(chunk: int, parts: list, ids: list[pa.Array]) -> pa.RecordBatch:
        codes, known = shared_codes([terms for terms, *_ in parts])
        firsts = np.cumsum([0, *map(len, ids)])
        keys = np.concatenate([own[of] * CHUNK_DOCUMENTS + (first + place)
                               for own, first, (_, of, place, _) in zip(codes, firsts, parts)])
        counts = np.concatenate([n for *_, n in parts])
        parts.clear()
        docs = pa.concat_arrays(ids)
        counts = counts[np.argsort(keys)]
        keys.sort()
        terms, places = keys // CHUNK_DOCUMENTS, (keys % CHUNK_DOCUMENTS).astype(np.int16)
        lengths = np.bincount(places, counts, len(docs)).astype(np.int32)
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        # the row of the documents comes first
        ends = pa.array(np.concatenate([[0], starts, [len(terms)]]), pa.int32())
        own = pa.array(np.concatenate([[0, len(docs)], len(docs) + np.append(starts, len(terms))[1:]]), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array([f" {chunk}"]), known.take(pa.array(terms[starts]))]),
             pa.array(np.full(len(starts) + 1, chunk)),
             pa.ListArray.from_arrays(ends, pa.array(places)),
             pa.ListArray.from_arrays(own, pa.array(np.concatenate([lengths, counts]))),
             pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
                               pa.nulls(len(starts), pa.list_(docs.type))])], schema.fieldNames())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, ids, postings, places = TaskContext.get().partitionId() << _CHUNKS_BITS, [], [], 0, 0
        for batch in sliced(batches):
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                if postings >= LISTED or places + part.num_rows > CHUNK_DOCUMENTS:
                    yield lists(chunk, parts, ids)
                    chunk, parts, ids, postings, places = chunk + 1, [], [], 0, 0
                parts.append(counted(part))
                ids.append(part.column("doc_id"))
                postings, places = postings + len(parts[-1][1]), places + part.num_rows
        if parts:
            yield lists(chunk, parts, ids)

    return low.mapInArrow(listed, schema)


def term_lists(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(term, docs, shares): the lists of all chunks with their documents' ids, and :func:`term_counts` of these."""
    found = chunk_lists(documents, doc_id, text)
    named = found.filter("docs is not null").select("chunk", F.col("docs").alias("ids"), F.col("counts").alias("lengths"))
    shares = F.zip_with("counts", "places", lambda n, at: n / F.get("lengths", at))
    return found.filter("docs is null").join(named, "chunk").select(
        "term", F.transform("places", lambda at: F.get("ids", at)).alias("docs"), shares.alias("shares"))


def shared_codes(parts: list[pa.Array]) -> tuple[list[np.ndarray], pa.Array]:
    """The terms of some arrays by number, the same in all of them, and the terms so numbered."""
    codes = pa.concat_arrays(parts).dictionary_encode()
    ends = np.cumsum([len(p) for p in parts])
    return np.split(codes.indices.to_numpy().astype(np.int64), ends[:-1]), codes.dictionary


def grouped_term_counts(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """:func:`term_counts` by a hash aggregate: one shuffle of the postings, but compiled code, which
    is the quicker way for the few documents that one question selects."""
    sized = _tokenized(documents, doc_id, text).withColumn("length", F.size("tokens"))
    return (_exploded(sized, F.col("tokens"), "doc_id", "length")
            .groupBy("doc_id", "length", "term").agg(F.count("*").alias("n"))
            .select("doc_id", "term", (F.col("n") / F.col("length")).alias("tf")))


def _weighted(counts: DataFrame, frequency: DataFrame, corpus_size: Column, build_keyed: bool = False) -> DataFrame:
    idf = F.log(corpus_size / (F.col("df") + 1))
    return (join_counted_key(counts, frequency, "term", "df", "doc_id", build_keyed)
            .withColumn("weight", F.col("tf") * idf))


def tfidf_weights(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (doc_id, term, tf, df, weight). Write it once and search it many times."""
    size = documents.agg(F.count("*")).scalar()
    return _weighted(term_counts(documents, doc_id, text),
                     document_frequency(documents, doc_id, text), size, build_keyed=True
                     ).select("doc_id", "term", "tf", "df", "weight")


def query_weights(query: str) -> dict[str, float]:
    """Share of each term among all the query's tokens, known to the corpus or not."""
    found = re.findall(r"\w+", query.lower())
    return {term: n / len(found) for term, n in Counter(found).items()}


def asked_weight(term: Column, wanted: dict[str, float]) -> Column:
    """The query's weight of a term; null for other terms."""
    pairs = [F.lit(x) for item in wanted.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), term) if pairs else F.lit(None).cast("double")


def ranked(dots: DataFrame, query_norm: Column, k: int) -> DataFrame:
    """Top k of (doc_id, dot, norm) by the exact cosine; documents of no similarity are no hits.

    Sums of equal documents can differ in their last bits, by the order of summation. So scores that
    agree in 12 decimals rank by id; the score itself is not rounded, nor is the test for hits.
    """
    score = F.when((F.col("norm") == 0) | (query_norm == 0), 0.0).otherwise(
        F.col("dot") / (F.col("norm") * query_norm))
    return (dots.select("doc_id", score.alias("score")).filter("score > 0")
            .orderBy(F.round("score", 12).desc(), "doc_id").limit(k))


def known_norm(known: Column, wanted: dict[str, float]) -> Column:
    """Norm of the query over the terms in the array `known`."""
    total = F.lit(0.0)
    for term, weight in wanted.items():
        total = total + F.when(F.array_contains(known, term), weight * weight).otherwise(0.0)
    return F.sqrt(total)


def listed_postings(lists: DataFrame) -> DataFrame:
    """(place, count), one row per posting, with the other columns of the lists."""
    kept = [c for c in lists.columns if c not in ("places", "counts")]
    return lists.select(*kept, F.explode(F.arrays_zip("places", "counts")).alias("x")).select(
        *kept, F.col("x.places").alias("place"), F.col("x.counts").alias("count"))


def listed_norms(lists: DataFrame) -> DataFrame:
    """(chunk, place, doc_id, length, norm, largest): every document with its largest weight.

    A task adds up what its lists give to a document and hands on one sum, not a row per posting. There are
    as many tasks as the cores can do in two turns, so that the sums of a document do not grow with the table.
    """
    schema = "chunk long, sums array<double>, tops array<double>"

    def held(chunks: list[int], sums: np.ndarray, tops: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at, chunk in enumerate(chunks):
            of = slice(at * CHUNK_DOCUMENTS, (at + 1) * CHUNK_DOCUMENTS)
            used = np.flatnonzero(tops[of] > -np.inf).max(initial=-1) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([sums[of][:used]]), pa.array([tops[of][:used]])], ["chunk", "sums", "tops"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sums, tops = {}, np.zeros(0), np.zeros(0)
        for batch in sliced(batches):
            chunks, of = np.unique(batch.column("chunk").to_numpy(), return_inverse=True)
            if len(slots) + len(chunks) > max(_SUMMED_CHUNKS, len(chunks)):
                yield from held(list(slots), sums, tops)
                slots, sums, tops = {}, np.zeros(0), np.zeros(0)
            numbers = np.array([slots.setdefault(c, len(slots)) for c in chunks.tolist()], dtype=np.int64)
            more = np.zeros(max(0, len(slots) * CHUNK_DOCUMENTS - len(sums)))
            sums, tops = np.concatenate([sums, more]), np.concatenate([tops, more - np.inf])
            lengths = pc.list_value_length(batch.column("places")).to_numpy()
            at = np.repeat(numbers[of] * CHUNK_DOCUMENTS, lengths) + batch.column("places").flatten().to_numpy()
            weights = batch.column("counts").flatten().to_numpy() * np.repeat(batch.column("idf").to_numpy(), lengths)
            np.add.at(sums, at, weights * weights)
            np.maximum.at(tops, at, weights)
        yield from held(list(slots), sums, tops)

    def total(parts: pa.Table) -> pa.Table:
        sums = [x.values.to_numpy() for x in parts.column("sums")]
        whole, tops = np.zeros(max(map(len, sums))), np.full(max(map(len, sums)), -np.inf)
        for some, top in zip(sums, parts.column("tops")):
            whole[:len(some)] += some
            tops[:len(some)] = np.maximum(tops[:len(some)], top.values.to_numpy())
        return pa.table({"chunk": parts.column("chunk").slice(0, 1), "sums": [whole], "tops": [tops]})

    tasks = 2 * lists.sparkSession.sparkContext.defaultParallelism
    found = (lists.filter("docs is null").select("chunk", "idf", "places", "counts").coalesce(tasks)
             .mapInArrow(added, schema).groupBy("chunk").applyInArrow(total, schema))
    named = lists.filter("docs is not null").select("chunk", "docs", F.col("counts").alias("lengths"))
    each = named.join(found, "chunk", "left").select(
        "chunk", F.posexplode(F.arrays_zip("docs", "lengths", "sums", "tops")).alias("place", "x"))
    return each.select("chunk", F.col("place").cast("short").alias("place"), F.col("x.docs").alias("doc_id"),
                       F.col("x.lengths").alias("length"),
                       F.coalesce(F.try_divide(F.sqrt("x.sums"), "x.lengths"), F.lit(0.0)).alias("norm"),
                       F.try_divide("x.tops", "x.lengths").alias("largest"))


@dataclass
class TextIndex:
    """Lists (:func:`chunk_lists`, and idf) and norms (:func:`listed_norms`) of a document table.

    Both have to come from the same chunks. So an index that is used before it is written is written first, to a
    folder of its own beside the reliable checkpoints.
    """

    lists: DataFrame
    stored_norms: DataFrame | None = None

    @property
    def norms(self) -> DataFrame:
        if self.stored_norms is None:
            self.write(f"{ensure_checkpoint_dir(self.lists.sparkSession).rstrip('/')}/text-index-{uuid.uuid4().hex}")
        return self.stored_norms

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, weight), one row per posting."""
        norms = self.norms
        found = listed_postings(self.lists.filter("docs is null")).join(norms, ["chunk", "place"])
        return found.select("term", "doc_id", (F.col("count") / F.col("length") * F.col("idf")).alias("weight"))

    def write(self, path: str) -> None:
        """Store the index, each file in term order, so that a question reads its terms only."""
        spark = self.lists.sparkSession
        (self.lists.sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd")
         .parquet(f"{path}/postings"))
        listed_norms(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/norms")
        stored = self.read(spark, path)
        self.lists, self.stored_norms = stored.lists, stored.stored_norms

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/norms"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(doc_id, score), best first. Reads the lists of the query's terms and joins the norms
        of the documents they name."""
        wanted, norms = query_weights(query), self.norms
        found = self.lists.filter(F.col("term").isin(list(wanted)))
        norm = found.agg(known_norm(F.collect_set("term"), wanted)).scalar()
        asked = asked_weight(F.col("term"), wanted) * F.col("idf") * F.col("count")
        dots = listed_postings(found).groupBy("chunk", "place").agg(F.sum(asked).alias("_dot"))
        each = dots.join(norms, ["chunk", "place"])
        return ranked(each.select("doc_id", (F.col("_dot") / F.col("length")).alias("dot"), "norm"), norm, k)


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> TextIndex:
    """The index of all documents, not computed yet; `write` does that and reads each text once.

    The lists are shuffled once, by term, and their sizes tell the term's frequency where they meet."""
    size = documents.agg(F.count("*")).scalar()
    frequency = F.sum(F.size("places")).over(Window.partitionBy("term"))
    found = chunk_lists(documents, doc_id, text).withColumn("_df", frequency)
    return TextIndex(found.withColumn("idf", F.log(size / (F.col("_df") + 1))).drop("_df"))


def tfidf_search(documents: DataFrame, query: str, k: int = 10, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Search documents directly: (doc_id, score), best first, ties in document order.

    All documents take part in the document frequencies; weights are built only for those that hold
    a query term, since no other document can score. For more than one question, store an index.
    """
    wanted = query_weights(query)
    asked = F.array(*(F.lit(t) for t in wanted)).cast("array<string>")
    words = tokens(F.col(text))
    candidates = documents.filter(F.arrays_overlap(words, asked))
    # corpus size, and the query's norm over the terms the corpus knows, from one pass
    held = F.array_distinct(F.flatten(F.collect_set(F.array_intersect(words, asked))))
    corpus = documents.agg(F.struct(F.count("*").alias("size"), known_norm(held, wanted).alias("norm"))
                           ).scalar()
    weights = _weighted(grouped_term_counts(candidates, doc_id, text),
                        document_frequency(documents, doc_id, text), corpus["size"])
    dots = weights.groupBy("doc_id").agg(
        F.sum(asked_weight(F.col("term"), wanted) * F.col("weight")).alias("dot"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).filter("dot is not null")
    return ranked(dots, corpus["norm"], k)
