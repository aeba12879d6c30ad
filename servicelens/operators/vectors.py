"""Vector search over a table with a column of unit vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from servicelens import fields

CELLS = 100
QUESTION_BLOCK = 4096
RECALL = 0.9
SAMPLE = 200                    # questions that the number of probes is chosen with
_FILES_PER_CELL = 4
_PRODUCT_ROWS = 1024            # rows multiplied at a time
_ROUNDING = 1e-9                # relative; more than the order of summing changes a product
_RING_SLACK = 1e-6              # parts of a half turn; an angle near zero is known to about 1e-8


def scored(vectors: DataFrame, query: Sequence[float], row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Inner product of every vector with the query: (id, score). Rows without a vector are no hits.

    One product per Arrow batch, in double; each row is summed alike, so equal vectors score equally.
    """
    asked = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def inner(rows: pd.Series) -> pd.Series:
        if rows.empty:
            return pd.Series([], dtype="float64")
        return pd.Series((np.stack(rows.to_numpy()).astype(np.float64) * asked).sum(axis=1))

    return vectors.filter(F.col(vector).isNotNull()).select(F.col(row_id).alias("id"), inner(vector).alias("score"))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, row_id: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """Exact top k by inner product: (id, score), equal scores by id. Each task keeps k rows."""
    return scored(vectors, query, row_id, vector).orderBy(F.col("score").desc(), "id").limit(k)


def nearest_many(vectors: DataFrame, questions: DataFrame, k: int, row_id: str = "vec_id",
                 vector: str = "embedding", question_id: str = "question", block: int = QUESTION_BLOCK
                 ) -> DataFrame:
    """:func:`nearest` for a table of questions with unique ids: (question, id, score, rank).

    Questions go in blocks of about `block`, each one pass over the vectors. A task multiplies whole
    Arrow batches by the block and keeps k rows per question, so no pair of question and vector is ever
    a row; the lists of all tasks are merged per question. The matrix product only finds candidates: what
    comes within rounding of a list is scored again as `nearest` does it, so both agree bit for bit.
    """
    asked = questions.filter(F.col(vector).isNotNull()).select(
        F.col(question_id).alias("question"), F.col(vector).cast("array<double>").alias("asked"))
    blocks = max(1, -(-asked.count() // block))
    table = vectors.filter(F.col(vector).isNotNull()).select(
        F.col(row_id).alias("id"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in (*asked.schema.fields, *table.schema.fields)}
    schema = f"question {kinds['question']}, id {kinds['id']}, score double"
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("question"), F.lit(blocks)))
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), "id")
    parts = []
    for n in range(blocks):
        listed = (numbered.filter(F.col("_block") == n)
                  .agg(F.collect_list(F.struct("question", "asked")).alias("rows")).first()["rows"])
        names = [r["question"] for r in listed]
        matrix = np.array([r["asked"] for r in listed], dtype=np.float64)
        found = table.mapInPandas(_kept_lists(names, matrix, k), schema)
        parts.append(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    return reduce(DataFrame.unionAll, parts)


def _kept_lists(names: list, matrix: np.ndarray, k: int) -> Callable:
    """For one task: the k best rows of each question, best first and equal scores by id."""
    def kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: list[list[tuple[float, object]]] = [[] for _ in names]
        floor = np.full(len(names), -np.inf)
        sizes = np.linalg.norm(matrix, axis=1) if names else floor
        for frame in frames:
            if frame.empty or not names:
                continue
            rows = np.stack(frame["vector"].to_numpy()).astype(np.float64)
            ids = frame["id"].tolist()
            for at in range(0, len(rows), _PRODUCT_ROWS):
                part = rows[at:at + _PRODUCT_ROWS]
                margin = _ROUNDING * np.linalg.norm(part, axis=1).max() * sizes
                close = (part @ matrix.T) >= floor - margin
                for n in np.flatnonzero(close.any(axis=0)).tolist():
                    chosen = np.flatnonzero(close[:, n])
                    scores = (part[chosen] * matrix[n]).sum(axis=1)
                    lists[n] += [(-x, ids[at + i]) for x, i in zip(scores.tolist(), chosen.tolist())]
                    lists[n] = heapq.nsmallest(k, lists[n])
                    if len(lists[n]) == k:
                        floor[n] = -lists[n][-1][0]
        flat = [(name, number, -score) for name, held in zip(names, lists) for score, number in held]
        yield pd.DataFrame(flat, columns=["question", "id", "score"])

    return kept


def _directions(centres: np.ndarray) -> np.ndarray:
    """Unit vectors; a centre of length zero gets the first axis, as any direction serves a bound."""
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    axis = np.eye(1, centres.shape[1])
    return np.where(lengths > 0, centres / np.where(lengths > 0, lengths, 1), axis)


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


@dataclass
class CellIndex:
    """Vectors in coarse cells, and the cells.

    `vectors` has `cell` and `place`: the cell's number plus the angle to its centre, in parts of a
    half turn. `centres` has cell, centre, rows, and the least and most place and the most length of the
    cell's vectors. `probes` is how many cells an approximate search looks into.
    """

    vectors: DataFrame
    centres: DataFrame
    probes: int = fields.PROBES

    def probe(self, query: Sequence[float], k: int, probes: int, row_id: str = "vec_id",
              vector: str = "embedding") -> DataFrame:
        """Top k among the cells whose centres are nearest to the query, re-ranked exactly.

        The centres are as many as the cells, so their nearest ones are a top list of `probes` rows.
        """
        near = nearest(self.centres, query, probes, "cell", "centre").select(F.col("id").alias("_cell"))
        found = self.vectors.join(F.broadcast(near), F.col("cell") == F.col("_cell"), "left_semi")
        return nearest(found, query, k, row_id, vector)

    def recalls(self, questions: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding",
                question_id: str = "question") -> DataFrame:
        """(probes, recall): the share of the exact hits of the questions that so many probes find."""
        told = self.centres.agg(F.collect_list(F.struct("cell", "centre"))).first()[0]
        numbers, centres = [c["cell"] for c in told], np.array([c["centre"] for c in told])

        @F.pandas_udf("int")
        def place_of(rows: pd.Series, cells: pd.Series) -> pd.Series:
            places = []
            for row, cell in zip(rows, cells):
                scores = (centres * np.asarray(row, dtype=np.float64)).sum(axis=1)
                order = sorted(range(len(numbers)), key=lambda i: (-scores[i], numbers[i]))
                places.append(1 + [numbers[i] for i in order].index(cell))
            return pd.Series(places, dtype="int32")

        exact = nearest_many(self.vectors, questions, k, row_id, vector, question_id).select("question", "id")
        asked = questions.select(F.col(question_id).alias("question"), F.col(vector).alias("_asked"))
        hits = exact.join(self.vectors.select(F.col(row_id).alias("id"), "cell"), "id").join(asked, "question")
        found = hits.groupBy(place_of("_asked", "cell").alias("probes")).agg(F.count("*").alias("hits"))
        upto = Window.orderBy("probes")                 # as many rows as cells
        return found.select("probes", (F.sum("hits").over(upto) / F.lit(exact.count())).alias("recall"))

    def calibrated(self, k: int, recall: float = RECALL, questions: int = SAMPLE, row_id: str = "vec_id",
                   vector: str = "embedding") -> CellIndex:
        """The index with the fewest probes that reach the recall for a sample of its own vectors, those
        whose ids hash lowest."""
        sample = (self.vectors.orderBy(F.xxhash64(row_id), row_id).limit(questions)
                  .select(F.col(row_id).alias("question"), vector))
        enough = self.recalls(sample, k, row_id, vector).filter(F.col("recall") >= recall)
        return CellIndex(self.vectors, self.centres, enough.agg(F.min("probes")).first()[0] or self.probes)

    def reach(self, query: Sequence[float], k: int, probes: int = fields.PROBES, vector: str = "embedding"
              ) -> list[tuple[int, float, float]]:
        """(cell, least place, most place) outside of which no vector is among the top k.

        The `probes` nearest cells give a score that k vectors reach. By the triangle inequality of
        angles, a vector that scores as much lies in a ring around each centre: its angle there differs
        from the query's by no more than the angle that the score stands for. Cells without a vector in
        the ring are left out. The list is as long as the cells at most.
        """
        asked = np.asarray(query, dtype=np.float64)
        size = float(np.linalg.norm(asked))
        cells = self.centres.agg(F.collect_list(F.struct(
            "cell", "centre", "least_place", "most_place", "most_length"))).first()[0]
        if not cells:
            return []
        centres = np.array([c["centre"] for c in cells], dtype=np.float64)
        toward = _angle(_directions(centres) @ asked / size) if size else np.zeros(len(cells))
        first = [cells[i]["cell"] for i in np.argsort(toward, kind="stable")[:probes]]
        found = nearest(self.vectors.filter(F.col("cell").isin(first)), query, k, "cell", vector)
        least = found.agg(F.when(F.count("*") >= k, F.min("score"))).first()[0]
        rings = []
        for cell, angle in zip(cells, toward.tolist()):
            number, most = cell["cell"], size * cell["most_length"]
            wide = math.pi
            if least is not None and least > 0:
                if most * (1 + _ROUNDING) < least:
                    continue
                wide = math.acos(min(least / most, 1.0)) if most else math.pi
            low = number + (angle - wide) / math.pi - _RING_SLACK
            high = number + (angle + wide) / math.pi + _RING_SLACK
            if low <= cell["most_place"] and high >= cell["least_place"]:
                rings.append((number, low, high))
        return rings

    def nearest(self, query: Sequence[float], k: int, probes: int = fields.PROBES, row_id: str = "vec_id",
                vector: str = "embedding") -> DataFrame:
        """The exact top k, as of the whole table, from the rings that can hold it.

        Cells are folders and places are sorted in their files, so folders and row groups outside of
        the rings are not read.
        """
        rings = self.reach(query, k, probes, vector)
        inside = reduce(or_, [F.col("place").between(low, high) for _, low, high in rings], F.lit(False))
        found = self.vectors.filter(F.col("cell").isin([cell for cell, *_ in rings]) & inside)
        return nearest(found, query, k, row_id, vector)

    def write(self, path: str, row_id: str = "vec_id") -> None:
        """Store centres and vectors, one folder per cell, so that a search reads only its cells.

        The rows of a cell are dealt to a few writers by id, which bounds the files of a cell and
        keeps a large cell from being one task.
        """
        part = F.pmod(F.xxhash64(row_id), F.lit(_FILES_PER_CELL))
        (self.vectors.repartition("cell", part).sortWithinPartitions("cell", "place").write
         .mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))
        self.centres.write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def read(cls, spark: SparkSession, path: str, probes: int = fields.PROBES) -> CellIndex:
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centres"), probes)


def build_cells(vectors: DataFrame, vector: str = "embedding", cells: int = CELLS,
                seed: int = 42) -> CellIndex:
    """Fit the cell centres on all vectors and assign every vector to its cell.

    The fit passes over the vectors several times. Build once, store with `write`, and search the
    stored index. Rows without a vector are left out, as they are no hits.
    """
    present = vectors.filter(F.col(vector).isNotNull())
    features = present.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model: KMeansModel = KMeans(k=cells, featuresCol="_features", predictionCol="cell",
                                seed=seed, maxIter=10).fit(features)
    means = [c.tolist() for c in model.clusterCenters()]
    towards = _directions(np.array(means))

    @F.pandas_udf("place double, length double")
    def measured(rows: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"place": [], "length": []}, dtype="float64")
        matrix, at = np.stack(rows.to_numpy()).astype(np.float64), numbers.to_numpy()
        lengths = np.linalg.norm(matrix, axis=1)
        cosines = (matrix * towards[at]).sum(axis=1) / np.where(lengths > 0, lengths, 1)
        return pd.DataFrame({"place": at + _angle(cosines) / math.pi, "length": lengths})

    placed = (model.transform(features).withColumn("_measured", measured(vector, "cell"))
              .select(*vectors.columns, "cell", F.col("_measured.place").alias("place"),
                      F.col("_measured.length").alias("_length")))
    stats = placed.groupBy("cell").agg(
        F.count("*").alias("rows"), F.min("place").alias("least_place"), F.max("place").alias("most_place"),
        F.max("_length").alias("most_length"))
    centres = vectors.sparkSession.createDataFrame(list(enumerate(means)), "cell int, centre array<double>")
    return CellIndex(placed.drop("_length"), centres.join(stats, "cell"))


def search(vectors: DataFrame | CellIndex, query: Sequence[float], k: int, row_id: str = "vec_id",
           vector: str = "embedding", method: str = "exact", probes: int | None = None) -> DataFrame:
    """Top k of a table, or of a built or stored index.

    `method="exact"` is exact: a table is scanned, an index read as far as a hit can be.
    `method="cells"` looks into the nearest cells of an index only, `probes` or as many as the index says.
    """
    if method == "exact":
        if isinstance(vectors, CellIndex):
            return vectors.nearest(query, k, probes or vectors.probes, row_id, vector)
        return nearest(vectors, query, k, row_id, vector)
    if method != "cells" or not isinstance(vectors, CellIndex):
        raise ValueError('method is "exact", or "cells" with an index')
    return vectors.probe(query, k, probes or vectors.probes, row_id, vector)
