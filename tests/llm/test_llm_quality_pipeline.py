"""Classifier, pipeline and registration."""

import sys
import zlib
from pathlib import Path
from unittest import mock

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import __spark_entry__ as driver
import corpus_pipeline
from servicelens.llm import decontamination, mil, queries, secret_scan, simhash

SMALL, SF_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_passages_cover_the_text():
    for n in (0, 1, 63, 64, 65, 100, 5000):
        rows = mil.passages(" ".join(f"w{i}" for i in range(n)))
        assert rows.shape == (max(1, round(n / mil.PASSAGE_WORDS)), mil.FEATURES)
        assert np.isfinite(rows).all()
    assert mil.passages(None).tolist() == mil.passages("").tolist() == [[0.0] * mil.FEATURES]


def test_share_of_the_most_frequent_word_counts_all_words():
    for at in range(40):
        words = [f"w{i}" for i in range(40)]
        words[at:at] = [words[at]] * 24
        assert mil.passages(" ".join(words))[0, 9] == pytest.approx(25 / 64)


def test_gradients_descend_and_attention_finds_the_telling_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(1, 9), mil.FEATURES))
        if i % 2:
            bag[rng.integers(len(bag)), 3] = 6.0
        bags.append(bag.astype(np.float32))
        labels.append(i % 2)
    model = mil.fit(bags[:200], np.array(labels[:200]))
    right = [(model.score(b) >= 0.5) == y for b, y in zip(bags[200:], labels[200:])]
    assert np.mean(right) > 0.9


def test_attention_decides_where_one_passage_tells():
    """Bags of many plain passages and one telling one: with equal weights the model errs."""
    rng = np.random.default_rng(4)
    bags, labels = [], []
    for i in range(400):
        bag = rng.normal(0, 1, (rng.integers(10, 40), mil.FEATURES))
        if i % 2:
            bag[rng.integers(len(bag)), 3] += 5.0
        bags.append(bag.astype(np.float32))
        labels.append(i % 2)
    model = mil.fit(bags[:300], np.array(labels[:300]))
    even = mil.Model(model.base, model.mean, model.scale, {**model.weights, "attend": np.zeros(mil.HIDDEN)})
    right, without = ([(m.score(b) >= 0.5) == y for b, y in zip(bags[300:], labels[300:])] for m in (model, even))
    assert np.mean(right) > 0.9 and np.mean(without) < 0.7
    x = (bags[1] - model.mean) / model.scale
    weights = mil._forward(model.weights, x, np.zeros(1, dtype=np.int64), np.zeros(len(x), dtype=np.int64))["a"]
    assert weights.argmax() == bags[1][:, 3].argmax() and weights.max() > 5 / len(x)


def test_the_fit_takes_whole_texts_and_one_row_per_id(rows):
    texts = {i: " ".join(f"{'good' if i % 2 else 'bad'}{k % 9}" for k in range(64 * (1 + i % 5))) for i in range(40)}
    docs = rows("doc_id bigint, text string", *texts.items(), *[(1, texts[1])] * 30, (1, "zzz"), (None, "x"))
    labels = rows("doc_id bigint, quality int, QUALITY string", *((i, i % 2, "") for i in texts))
    seen = []
    with mock.patch.object(mil, "fit", lambda bags, y: seen.append([len(b) for b in bags]) or mil.Model(0.5)):
        mil.train(docs, labels)
        mil.train(docs, labels, train_passages=20)
    kept = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(seen[0]) == len(kept) and 3 <= len(seen[1]) < len(kept) and sum(seen[1]) <= 20
    assert sum(seen[0]) in (sum(1 + i % 5 for i in kept), sum(1 + i % 5 for i in kept) - 1)     # id 1 by either text


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2]
    x = rng.normal(size=(7, 3))
    starts, bag = np.array([0, 1, 5]), np.repeat(np.arange(3), sizes)
    w = {"encode": rng.normal(size=(3, 16)), "encode_b": rng.normal(size=16), "tanh": rng.normal(size=(16, 16)),
         "gate": rng.normal(size=(16, 16)), "attend": rng.normal(size=16), "score": rng.normal(size=16), "score_b": np.array(0.1)}
    f = mil._forward(w, x, starts, bag)
    assert np.add.reduceat(f["a"], starts) == pytest.approx(np.ones(3))
    assert ((0 < f["score"]) & (f["score"] < 1)).all()


def test_degenerate_training():
    assert mil.fit([], np.array([])).score(mil.passages("x")) == 0.5
    assert mil.fit([mil.passages("x")], np.array([1])).score(mil.passages("y")) == 1.0


def test_classifier_on_held_out_documents(spark):
    found = queries.QUERIES["op2_quality_classifier"](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = found.where("held_out").join(labels, "doc_id").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert judged > 0.9


def test_classifier_edges(rows):
    docs = rows("doc_id bigint, text string, score int, Text int", (1, None, 0, 0), (None, "", 0, 0), (2, "good words here", 0, 0),
                (2, "good words here", 0, 0), (3, "x " * 9000, 0, 0))
    labels = rows("doc_id bigint, quality int, toxic int", (2, 1, 0), (3, 0, 0), (None, 1, 0), (1, None, None), (8, 1, 0))
    found = mil.score(docs, mil.train(docs, labels)).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert mil.score(docs.limit(0), mil.train(docs.limit(0), labels)).count() == 0


COLUMNS = list(corpus_pipeline.COLUMNS)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark, tmp_path):
    """Each stage against its operator's own verdicts, on what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    results = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        results.append(docs)
    judged, single, clean, masked, packed = results
    assert all(r.columns == COLUMNS for r in results[:4])
    groups = simhash.near_duplicates(judged)
    assert ids(single) == sorted({r.component_id for r in groups.collect()})
    texts = {r.doc_id: r.text for r in single.collect()}
    items = [decontamination.alnum_words(r.text.encode()) for r in benchmark.collect()]

    def leaks(text):
        here = b" ".join(decontamination.alnum_words(text.encode()))
        return any(b" " + b" ".join(i) + b" " in b" " + here + b" " for i in items)

    assert set(ids(single)) - set(ids(clean)) >= {i for i, t in texts.items() if leaks(t)}
    assert len(ids(single)) - len(ids(clean)) <= len(texts) // 10
    assert ids(masked) == ids(clean)
    for row in masked.collect():
        wanted = texts[row.doc_id]
        assert row.text == secret_scan.masked(wanted, secret_scan.segment_spans([wanted])[0])
        assert row.n_chars == len(row.text)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids(masked))


def test_stages_on_odd_rows(spark, rows, tmp_path):
    prose = " ".join(f"the w{i} of" for i in range(40))
    docs = rows("doc_id bigint, text string, lang string, source string, n_chars bigint, Doc_ID int, spans int",
                (1, prose, "en", "s", 1, 0, 0), (1, prose, "en", "s", 1, 0, 0), (2, None, None, None, None, 0, 0),
                (None, prose + " x", None, None, None, 0, 0), (3, "", "en", "s", 0, 0, 0), (4, prose, "xx", "s", 1, 0, 0))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == COLUMNS
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    masked = corpus_pipeline.mask_secrets(spark, docs, SMALL).collect()
    assert sorted(str(r.doc_id) for r in masked) == ["1", "1", "2", "3", "4", "None"]
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert [r.doc_id for r in kept].count(1) == 1 and 4 not in [r.doc_id for r in kept]
    assert corpus_pipeline.pack(spark, docs, SMALL).count() == docs.count()


def test_near_dedup_tells_rows_of_one_id_apart(spark, rows):
    first, second = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = rows("doc_id bigint, text string, lang string, source string, n_chars bigint",
                *((i, t, "en", "s", 1) for i, t in ((0, first), (1, first), (1, second), (2, second), (2, None))))
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(0, first), (1, second), (2, "")]


def test_near_dedup_keeps_one_row_of_a_component(spark, rows):
    """Near copies under one id are one component, and two components can share their smallest id."""
    one, two = (" ".join(f"{w}{i}" for i in range(400)) for w in "ab")
    docs = rows("doc_id bigint, text string, lang string, source string, n_chars bigint",
                *((i, t, "en", "s", 1) for i, t in ((5, one), (5, f"{one} more"), (9, one), (5, two), (9, f"more {two}"),
                                                    (None, one), (None, one))))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()]
    assert len(kept) == 3 and kept.count((None, one)) == 1 and (5, two) in kept
    assert ((5, one) in kept) != ((5, f"{one} more") in kept)


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_registration():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(driver.queries())
