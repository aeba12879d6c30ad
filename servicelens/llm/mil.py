"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages, all of its text in windows of words. Each passage is encoded from
plain measurements of its characters, words and repetitions; gated attention weights say how much each
passage counts, the weighted mean of the encodings is the document, and a logistic unit scores it. All
weights are learned together from document labels alone.

The fit uses labelled documents in the order in which their ids hash, at most `TRAIN_DOCS` of them and as
many as have `TRAIN_PASSAGES` passages together, which bounds what reaches the driver. They enter whole.
Scoring covers every passage of every document, in one pass without a shuffle; the model is a few
kilobytes.

Nulls and special cases: a null text is an empty one; an empty text is one passage without words and
gets the model's score for it. Labels without an id or a quality are not used; several labels of one
document count as their mean. Without any label, or labels of one kind only, all scores are the share
of good labels, or 0.5. Repeated rows are scored alike; where an id has several texts, the fit takes the
one with the least key. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servicelens.llm.common import only, sliced, text_key

PASSAGE_WORDS = 64
TRAIN_DOCS = 4_000
TRAIN_PASSAGES = 200_000
CUT = 0.7
HIDDEN = 16
EPOCHS = 250
_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>@^~_=+\\/{}[]`")
_STOPS = bytes(range(256)).translate(None, b".,;:!?")
_DIGITS = bytes(range(256)).translate(None, b"0123456789")
_UPPER = bytes(range(256)).translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HIGH = bytes(range(128))
FEATURES = 12


def passages(text: str | None, words_each: int = PASSAGE_WORDS) -> np.ndarray:
    """Measurements of every passage: one row each, at least one row."""
    words = (text or "").encode().split()
    total = len(words)
    seen: set[tuple] = set()
    again = np.zeros(total + 1)
    for i, gram in enumerate(zip(words, words[1:], words[2:], words[3:])):
        if gram in seen:
            again[i + 1] = 1
        else:
            seen.add(gram)
    again = again.cumsum()
    parts = max(1, round(total / words_each))
    cuts = [total * i // parts for i in range(parts + 1)]
    rows = np.zeros((parts, FEATURES), dtype=np.float32)
    for row, (a, b) in zip(rows, zip(cuts, cuts[1:])):
        some = words[a:b]
        if not some:
            continue
        joined = b"".join(some)
        size, count = len(joined), b - a
        times = Counter(some)
        row[:] = (
            min(count, words_each) / words_each, size / count / 10, len(times) / count,
            len(joined.translate(None, _SYMBOLS)) / size, len(joined.translate(None, _STOPS)) / size,
            len(joined.translate(None, _DIGITS)) / size, len(joined.translate(None, _UPPER)) / size,
            len(joined.translate(None, _HIGH)) / size,
            sum(x == y for x, y in zip(some, some[1:])) / count,
            max(times.values()) / count,
            (again[b] - again[a]) / count, sum(map(bytes.isupper, some)) / count)
    return rows


@dataclass
class Model:
    """Weights by name; without weights every score is `base`."""

    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def score(self, bag: np.ndarray) -> float:
        if self.weights is None:
            return self.base
        x = (bag - self.mean) / self.scale
        starts = np.zeros(1, dtype=np.int64)
        return float(_forward(self.weights, x, starts, np.zeros(len(bag), dtype=np.int64))["score"][0])


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
    h = np.tanh(x @ w["encode"] + w["encode_b"])
    t = np.tanh(h @ w["tanh"])
    g = 1 / (1 + np.exp(-(h @ w["gate"])))
    e = (t * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    score = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score_b"], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the cross entropy; the gradients are those of `_forward`."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(bags) or labels.min() == labels.max():
        return Model(float(labels.mean()) if len(bags) else 0.5)
    sizes = np.array([len(b) for b in bags])
    starts, bag = np.r_[0, sizes.cumsum()[:-1]], np.repeat(np.arange(len(bags)), sizes)
    raw = np.concatenate(bags).astype(np.float64)
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-3
    x = (raw - mean) / scale
    rng = np.random.default_rng(seed)
    shapes = {"encode": (x.shape[1], HIDDEN), "encode_b": (HIDDEN,), "tanh": (HIDDEN, HIDDEN),
              "gate": (HIDDEN, HIDDEN), "attend": (HIDDEN,), "score": (HIDDEN,), "score_b": ()}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    moved = {k: np.zeros(s) for k, s in shapes.items()}
    varied = {k: np.zeros(s) for k, s in shapes.items()}
    for step in range(1, epochs + 1):
        f = _forward(w, x, starts, bag)
        h, t, g, a, z = f["h"], f["t"], f["g"], f["a"], f["z"]
        d_out = (f["score"] - labels) / len(bags)
        d_z = d_out[:, None] * w["score"]
        d_a = (h * d_z[bag]).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, starts)[bag])
        d_t = d_e[:, None] * w["attend"] * g * (1 - t * t)
        d_g = d_e[:, None] * w["attend"] * t * g * (1 - g)
        d_h = a[:, None] * d_z[bag] + d_t @ w["tanh"].T + d_g @ w["gate"].T
        d_x = d_h * (1 - h * h)
        grads = {"encode": x.T @ d_x, "encode_b": d_x.sum(axis=0), "tanh": h.T @ d_t,
                 "gate": h.T @ d_g, "attend": (t * g).T @ d_e, "score": z.T @ d_out,
                 "score_b": d_out.sum()}
        for k, grad in grads.items():
            grad = grad + 1e-4 * w[k]
            moved[k] = 0.9 * moved[k] + 0.1 * grad
            varied[k] = 0.999 * varied[k] + 0.001 * grad * grad
            w[k] = w[k] - 0.03 * (moved[k] / (1 - 0.9 ** step)) / (
                np.sqrt(varied[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(float(labels.mean()), mean, scale, w)


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by CRC-32 of the id's digits; never a null id."""
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS,
          train_passages: int = TRAIN_PASSAGES) -> Model:
    """A model from a bounded sample of the labels that are not held out."""
    known = (only(labels, "doc_id", "quality").dropna()
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id")
             .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
             .withColumnRenamed("doc_id", "label_id"))
    rows = only(docs, "doc_id", "text").withColumn("key", text_key())
    sample = (rows.join(F.broadcast(known), rows.doc_id == known.label_id).groupBy("label_id", "label")
              .agg(F.min(F.struct("key", "text")).alias("one")).select("label_id", "label", "one.text"))
    size = F.greatest(F.round(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"[ \t-\r]+")) / PASSAGE_WORDS), F.lit(1))
    upto = Window.orderBy(F.xxhash64("label_id"), "label_id")           # over at most train_docs rows
    chosen = (sample.select("label_id", size.alias("size")).withColumn("sum", F.sum("size").over(upto))
              .where(F.col("sum") <= train_passages).select(F.col("label_id").alias("chosen_id")))
    sample = sample.join(F.broadcast(chosen), F.col("label_id") == F.col("chosen_id"), "left_semi")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bags = [passages(text).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bags, pa.binary())],
                                             ["label", "bag"])

    sample = sample.select("text", "label")
    found = sorted((bytes(r.bag), r.label) for r in sample.mapInArrow(measured, "label int, bag binary").collect())
    bags = [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b, _ in found]
    return fit(bags, np.array([label for _, label in found]))


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= cut) for every document."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [model.score(passages(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())],
                                             ["doc_id", "score"])

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(scored, "doc_id bigint, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))
