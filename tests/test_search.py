import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import cells
from pyspark.sql import functions as F

from servicelens.operators import fusion, search, skew, tfidf, vectors


# --- keyword --------------------------------------------------------------------------------------

def test_relevance(rows):
    df = rows("id int, work_content string, machine_model string",
              (1, "oil", "x"), (2, "OIL", "oil-1"), (3, None, "x"), (4, None, "oil"))
    got = cells(search.relevance_search(df, "Oil", ["id"]), "id", "relevance")
    assert got == [(2, 1.5), (1, 1.0), (4, 0.5)]
    assert search.relevance_search(df, "  ", ["id"]).count() == 4
    raw = rows("id int, `作業内容` string, `機種名` string, `他` string", (1, "oil", "x", None), (2, "OIL", "oil-1", None),
               (3, None, None, "oil"))
    assert cells(search.relevance_search(raw, "oil", ["id"]), "id", "relevance") == [(2, 1.5), (1, 1.0)]
    other = rows("id int, anything string", (1, "oil"))
    assert cells(search.relevance_search(other, "oil", ["id"]), "relevance") == [(0.5,)]


def test_record_hits(rows):
    df = rows("id int, work_content string, malfunction_content string, parts_name string, "
              "machine_model string, category string",
              (1, "oil", None, "", "U", "e"), (2, None, "oil", None, "U", "f"),
              (3, "x", None, None, "V", "e"))
    assert cells(search.record_hits(df, "OIL")) == [(2, 1.0, "不具合: oil"), (1, 1.0, "作業内容: oil")]
    assert cells(search.record_hits(df, "oil", {"category": "e", "machine_model": None}), "id") == [
        (1,)]
    assert cells(search.record_hits(df, "", n=2), "id") == [(3,), (2,)]
    assert cells(search.light_hits(df, "oil", 1), "id", "score") == [(1, 0.8)]
    with pytest.raises(ValueError):
        search.ilike_search(df, "oil", {"no_such": 1})


def test_summary(rows):
    case_rows = rows("id int, machine_model string, work_content string", (1, "U", "oil"),
                     (2, "V", "oil"))
    part_rows = rows("id int, machine_model string, work_content string, parts_name string",
                     (3, "U", "pump", "oil seal"), (4, "W", "no", None))
    summary, shown = search.fallback_search(case_rows, part_rows, "oil", ["id"])
    assert sorted(cells(summary), key=str) == sorted([
        ("all", None, 3, 1), ("machine_model", "U", 2, 1), ("machine_model", "V", 1, 2),
        ("work_content", "oil", 2, 1), ("work_content", "pump", 1, 2)], key=str)
    assert cells(shown, "id") == [(1,), (2,), (3,)]
    assert search.summary_text(summary, "oil").first()[0] == (
        "「oil」に関連するデータが3件見つかりました。\n主な機種: U(2件)、V(1件)\n"
        "主な作業内容: oil(2件)、pump(1件)")
    empty, _ = search.fallback_search(case_rows, part_rows, "zzz", ["id"])
    assert search.summary_text(empty, "zzz").first()[0] == (
        "「zzz」に関連するデータが見つかりませんでした。")


# --- skewed join ----------------------------------------------------------------------------------

def test_counted_key_join_with_a_hot_key(spark):
    data = spark.range(6000).select("id", F.expr("if(id % 3 = 0, 0, id)").alias("k"))
    keyed = data.groupBy("k").agg(F.count("*").alias("n"))
    out = skew.join_counted_key(data, keyed, "k", "n", spread_by="id")
    assert out.count() == 6000 and out.columns == ["k", "id", "n"]
    assert {r[0] for r in out.filter("k = 0").select("n").distinct().collect()} == {2000}
    assert out.select("id").distinct().count() == 6000


# --- TF-IDF -----------------------------------------------------------------------------------------

def tf_idf(texts):
    docs = [re.findall(r"\w+", t.lower()) for t in texts]
    df = Counter(t for d in docs for t in set(d))
    return [{t: n / len(d) * math.log(len(docs) / (df[t] + 1)) for t, n in Counter(d).items()}
            for d in docs]


def cosine_ranking(texts, question, k):
    weights = tf_idf(texts)
    asked = re.findall(r"\w+", question.lower())
    known = {t for w in weights for t in w}
    q = {t: n / len(asked) for t, n in Counter(asked).items() if t in known}
    scores = []
    for i, w in enumerate(weights):
        product = math.sqrt(sum(x * x for x in w.values()) * sum(x * x for x in q.values()))
        value = sum(q[t] * w[t] for t in q if t in w) / product if product else 0.0
        scores.append((i, value))
    return sorted((s for s in scores if s[1] > 0), key=lambda s: (-round(s[1], 12), s[0]))[:k]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["漏れ", "x_1"]
    made = [" ".join(["all"] * rng.randint(1, 3) + rng.choices(vocabulary, k=rng.randint(1, 30)))
            for _ in range(80)]
    return made + ["", "!!", "ALL all", "w1 w10 aw1"]


def test_weights_match_brute_force(rows, texts):
    df = rows("doc_id int, text string", *enumerate(texts))
    got = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.tfidf_weights(df).collect()}
    want = {(i, t): w for i, d in enumerate(tf_idf(texts)) for t, w in d.items()}
    assert got == pytest.approx(want)


def test_small_weights():
    one = tf_idf(["a b", "b c", "b d", "b"])
    assert one[0]["a"] == pytest.approx(0.346574, abs=1e-6) and one[0]["b"] < 0


@pytest.mark.parametrize("question", ["w1", "all w1 w2 unknown", "漏れ 漏れ x_1", "unknown", "?", ""])
def test_searches_match_brute_force(rows, texts, question):
    df = rows("doc_id int, text string", *enumerate(texts))
    want = cosine_ranking(texts, question, 10)
    for found in (tfidf.tfidf_search(df, question, 10), tfidf.build_index(df).search(question, 10)):
        assert [(i, pytest.approx(s)) for i, s in cells(found)] == want


def test_stored_text_index(spark, rows, texts, tmp_path):
    tfidf.build_index(rows("doc_id int, text string", *enumerate(texts))).write(str(tmp_path))
    index = tfidf.TextIndex.read(spark, str(tmp_path))
    found = index.search("all w1 w2 unknown", 10)
    assert [(i, pytest.approx(s)) for i, s in cells(found)] == cosine_ranking(texts, "all w1 w2 unknown", 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_tiny_similarities_are_hits(rows):
    long = "common " + " ".join(f"w{i}" for i in range(2000))
    df = rows("doc_id int, text string", *((i, f"common x{i}") for i in range(2000)), (5000, long),
              *((9000 + i, "other") for i in range(2)))
    found = dict(cells(tfidf.tfidf_search(df, "common", 5000)))
    assert len(found) == 2001 and 0 < found[5000] < 5e-6


# --- vectors ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def unit_vectors():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)) + 3 * np.eye(8)[rng.integers(0, 8, 400)]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_vector_search(spark, rows, unit_vectors, tmp_path):
    df = rows("vec_id int, embedding array<float>",
              *[(i, v.tolist()) for i, v in enumerate(unit_vectors)])
    q = unit_vectors[7].tolist()
    exact = cells(vectors.nearest(df, q, 10))
    want = np.argsort(-(unit_vectors @ unit_vectors[7]))[:10]
    assert [i for i, _ in exact] == want.tolist() and exact[0] == (7, pytest.approx(1.0))
    assert vectors.nearest(df, q, 1000).count() == 400
    assert cells(vectors.search(df, q, 10)) == exact
    with pytest.raises(ValueError):
        vectors.search(df, q, 10, method="cells")

    vectors.build_cells(df, cells=10).write(str(tmp_path))
    index = vectors.CellIndex.read(spark, str(tmp_path))
    assert index.vectors.count() == 400 and index.centres.count() == 10
    assert cells(vectors.search(index, q, 10, method="cells", probes=10)) == exact
    assert cells(vectors.search(index, q, 10)) == exact
    few = {i for i, _ in cells(index.probe(q, 10, probes=3))}
    assert len(few & set(want.tolist())) >= 7


def test_vectors_rank_by_the_exact_score(rows):
    near = [(i, [1.0, i * 1e-9]) for i in range(5)]
    df = rows("vec_id int, embedding array<double>", *near, (9, None), (8, [1.0, 4e-9]))
    assert [i for i, _ in cells(vectors.nearest(df, [0.0, 1.0], 3))] == [4, 8, 3]
    assert vectors.nearest(df, [0.0, 1.0], 10).count() == 6


# --- fusion -----------------------------------------------------------------------------------------

def test_fusion(rows):
    keyword = rows("id int, score double", (1, 1.0))
    semantic = rows("id int, score double", (1, 0.9), (2, 0.5))
    assert [r[0] for r in cells(fusion.fuse_union(keyword, semantic, 2))] == ["vec_1", "vec_2"]
    assert cells(fusion.fuse_union(keyword, semantic, 9))[2] == ("db_1", pytest.approx(0.3))
    assert cells(fusion.fuse_by_record(keyword, semantic, 9)) == [(1, pytest.approx(0.93)), (2, 0.35)]
    told = fusion.fuse_by_record(keyword.withColumn("content", F.lit("k")),
                                 semantic.withColumn("content", F.lit("s")), 9)
    assert cells(told, "id", "content") == [(1, "k"), (2, "s")]


def test_light_hybrid(rows):
    semantic = rows("id int, score double", (5, 0.8), (6, 0.9))
    keyword = rows("id int, score double", (5, 0.8), (4, 0.8))
    assert cells(fusion.light_hybrid(semantic, keyword, 3)) == [("doc_6", 0.9), ("struct_4", 0.8)]
    assert cells(fusion.light_hybrid(semantic, keyword, 1)) == []
    assert cells(fusion.light_hybrid(semantic, keyword, 4)) == [
        ("doc_6", 0.9), ("doc_5", 0.8), ("struct_4", 0.8), ("struct_5", 0.8)]


def test_context_stops_at_the_first_overflow(rows):
    header = len("【関連情報 - スコア: 0.90】\n") + 1
    sizes = [1500, 1500, 1500, 100]
    hits = rows("id int, score double, content string",
                *[(i, 0.9 - i / 10, "x" * (n - header)) for i, n in enumerate(sizes)])
    packed = fusion.pack_context(hits)
    assert cells(packed, "id", "position", "used_chars") == [(0, 1, 1500), (1, 2, 3000)]
    context = fusion.context(packed).first()[0]
    assert context.startswith("【関連情報 - スコア: 0.90】\nx") and len(context) == 3001
    assert cells(fusion.first_hits(hits, 1), "context_text")[0][0].startswith("関連情報: xx")


def test_records_of_hits(rows):
    hits = rows("id int, score double", (2, 0.5))
    records = rows("rid int, text string", (1, "a"), (2, "b"))
    assert cells(fusion.with_records(hits, records, "id", "rid"), "id", "text") == [(2, "b")]
