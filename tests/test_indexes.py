"""Stored indexes: each gives what the scan gives, and reads less where it can."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from conftest import cells
from hypothesis import given, settings
from hypothesis import strategies as st

from servicelens.functions.text import any_keyword, relevance
from servicelens.operators import block_max, filters, grams, search, tfidf, vectors


# --- vectors in cells -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(12, 16))
    v = middles[rng.integers(0, 12, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    v *= rng.uniform(0.5, 2, size=(1500, 1))
    v[7], v[8], v[9] = 0, v[10], -v[10]
    return v


@pytest.fixture(scope="module")
def cell_index(spark, clustered, tmp_path_factory):
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(clustered)), (9999, None)],
                               "vec_id int, embedding array<double>")
    path = str(tmp_path_factory.mktemp("cells"))
    vectors.build_cells(df, cells=15).write(path)
    return df, vectors.CellIndex.read(spark, path)


def test_cells_know_their_vectors(cell_index):
    _, index = cell_index
    assert index.vectors.count() == 1500
    assert sum(r.rows for r in index.centres.collect()) == 1500
    for r in index.centres.collect():
        assert r.cell <= r.least_place <= r.most_place <= r.cell + 1


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_rings_hold_the_exact_top_list(cell_index, clustered, k):
    df, index = cell_index
    rng = np.random.default_rng(2)
    asked = [clustered[3], clustered[10] * 3, -clustered[20], rng.normal(size=16), np.zeros(16), clustered[9]]
    for q in asked if k == 10 else asked[1:4]:
        assert cells(index.nearest(q.tolist(), k, probes=2)) == cells(vectors.nearest(df, q.tolist(), k))


def test_rings_leave_cells_out(cell_index, clustered):
    _, index = cell_index
    read = [len(index.reach(clustered[i].tolist(), 10, probes=2)) for i in range(20, 30)]
    assert np.mean(read) < 7 and min(read) <= 2             # of 15 cells
    assert len(index.reach(np.zeros(16).tolist(), 10)) == 15


def recall(df, index, asked):
    found = total = 0
    for q in asked:
        exact = {i for i, _ in cells(vectors.nearest(df, q.tolist(), 10))}
        found += len(exact & {i for i, _ in cells(vectors.search(index, q.tolist(), 10, method="cells"))})
        total += len(exact)
    return found / total


def test_recall_is_measured_and_reached(spark, rows, cell_index, clustered, tmp_path):
    """Probes chosen with some vectors reach the recall with others, on grouped and on spread vectors."""
    df, index = cell_index
    chosen = index.calibrated(10, questions=60)
    assert chosen.probes <= 3 and recall(df, chosen, clustered[20:50:4]) >= 0.9
    rng = np.random.default_rng(8)
    spread = rng.normal(size=(600, 12))
    flat = rows("vec_id int, embedding array<double>", *((i, v.tolist()) for i, v in enumerate(spread)))
    vectors.build_cells(flat, cells=20).write(str(tmp_path))
    index = vectors.CellIndex.read(spark, str(tmp_path))
    chosen = index.calibrated(10, questions=100)
    assert 3 < chosen.probes < 20 and recall(flat, chosen, rng.normal(size=(15, 12))) >= 0.85


def test_recalls_by_probes(rows, cell_index, clustered):
    df, index = cell_index
    asked = rows("question int, embedding array<double>", *((i, clustered[i].tolist()) for i in range(20, 30)))
    curve = cells(index.recalls(asked, 10).orderBy("probes"))
    assert [r for _, r in curve] == sorted(r for _, r in curve) and curve[-1][1] == 1.0
    for probes, share in curve[:2]:
        assert recall(df, replace(index, probes=probes), clustered[20:30]) == pytest.approx(share)


@pytest.mark.parametrize("block", [4096, 7])
def test_many_questions_as_one_by_one(rows, cell_index, clustered, block):
    df, _ = cell_index
    asked = [(f"q{i}", clustered[i].tolist()) for i in (3, 7, 8, 10, 11, 40, 41, 42, 43, 44)] + [("none", None)]
    got = {}
    for q, number, score, rank in cells(vectors.nearest_many(
            df.repartition(5), rows("question string, embedding array<double>", *asked), 6, block=block)):
        got.setdefault(q, []).append((rank, number, score))
    assert set(got) == {q for q, v in asked if v}
    for q, v in asked[:-1]:
        assert [(i, s) for _, i, s in sorted(got[q])] == cells(vectors.nearest(df, v, 6))


def test_many_questions_on_empty_tables(rows, cell_index):
    df, _ = cell_index
    asked = rows("question int, embedding array<double>", (1, [0.0] * 16))
    assert vectors.nearest_many(df.limit(0), asked, 3).count() == 0
    assert vectors.nearest_many(df, asked.limit(0), 3).count() == 0


# --- block-max postings -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def texts(spark):
    rand = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    data = []
    for i in range(1200):
        words = rand.choices(common, k=rand.choice([3, 8, 40, 150]))
        words += rand.choices(["rare", "odd", "seldom"], k=rand.random() < 0.05)
        data.append((i, " ".join(words)))
    data += [(1200, None), (1201, ""), (1202, "rare"), (1203, "rare"), (1204, "everywhere")]
    return spark.createDataFrame(data, "doc_id int, text string")


@pytest.fixture(scope="module")
def both_indexes(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("blocks")
    tfidf.build_index(texts).write(f"{path}/text")
    index = tfidf.TextIndex.read(spark, f"{path}/text")
    block_max.build_block_max(index, 16).write(f"{path}/blocks")
    return index, block_max.BlockMaxIndex.read(spark, f"{path}/blocks")


@pytest.mark.parametrize("query, k", [("rare", 10), ("rare c1 c2", 10), ("odd seldom", 1), ("c3 c4 c5 unknown", 10), ("c1", 1),
                                      ("unknown", 10), ("", 10), ("rare rare c9", 5)])
def test_blocks_find_what_the_index_finds(both_indexes, query, k):
    index, blocks = both_indexes
    got, want = cells(blocks.search(query, k)), cells(index.search(query, k))
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_blocks_skip_postings(both_indexes):
    _, blocks = both_indexes
    for query, share in (("c1 c2 c3", 0.9), ("rare c1", 0.9), ("c7", 0.5)):
        reading = blocks.plan(query, 5)
        assert reading.least is not None and reading.rows < share * reading.all_rows
    assert blocks.plan("rare", 5000).least is None          # fewer documents than asked: all blocks
    assert blocks.postings.groupBy("block").agg({"doc_id": "count"}).count() == 76


def test_lists_hold_the_weights(both_indexes, texts):
    """A term's documents come as lists; as rows they are the weights, from the same words."""
    index, _ = both_indexes
    assert index.lists.count() < index.postings.count() / 50
    want = {(t, d): w for t, d, w in cells(tfidf.tfidf_weights(texts), "term", "doc_id", "weight")}
    assert {(t, d): w for t, d, w in cells(index.postings, "term", "doc_id", "weight")} == pytest.approx(want)


def test_stored_postings_are_small(spark, tmp_path):
    """What is shuffled and stored of a posting is a place and a count, in lists, not an id and a weight."""
    rand = random.Random(6)
    df = spark.createDataFrame([(10 ** 12 + 7 * i, " ".join(rand.choices([f"w{j}" for j in range(300)], k=200)))
                                for i in range(2000)], "doc_id long, text string").coalesce(2)
    index = tfidf.build_index(df)
    plan = index.lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    index.write(f"{tmp_path}/text")
    index = tfidf.TextIndex.read(spark, f"{tmp_path}/text")
    block_max.build_block_max(index).write(f"{tmp_path}/blocks")
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert stored < 8 * index.postings.count()          # both indexes together; a double alone has 8 bytes


def test_documents_are_placed_in_passes(spark, both_indexes, tmp_path):
    """What is broadcast of the documents is bounded; more documents take more passes over the lists."""
    index, blocks = both_indexes
    block_max.build_block_max(index, 16, broadcast_documents=500).write(str(tmp_path))
    passes = block_max.BlockMaxIndex.read(spark, str(tmp_path))
    assert sorted(cells(passes.postings)) == sorted(cells(blocks.postings))
    assert sorted(cells(passes.tops)) == sorted(cells(blocks.tops))
    assert cells(passes.search("rare c1 c2", 10)) == cells(blocks.search("rare c1 c2", 10))


def test_chunks_do_not_change_the_index(rows, texts, both_indexes, monkeypatch):
    monkeypatch.setattr(tfidf, "LISTED", 500)
    monkeypatch.setattr(block_max, "ORDERED", 500)
    monkeypatch.setattr(tfidf, "_STEP", 7)
    monkeypatch.setattr(tfidf, "_SUMMED_CHUNKS", 2)
    index, blocks = both_indexes
    small = tfidf.build_index(texts.repartition(3))
    assert small.norms.select("chunk").distinct().count() > 20
    assert {d: n for d, n in cells(small.norms, "doc_id", "norm")} == pytest.approx(dict(cells(index.norms, "doc_id", "norm")))
    got = block_max.build_block_max(small, 16).search("rare c1 c2", 10)
    assert [d for d, _ in cells(got)] == [d for d, _ in cells(blocks.search("rare c1 c2", 10))]


def test_indexes_of_nothing(rows):
    for df in (rows("doc_id int, text string").limit(0), rows("doc_id int, text string", (1, None), (2, "--"))):
        index = tfidf.build_index(df)
        assert cells(index.search("a", 3)) == [] and cells(block_max.build_block_max(index).search("a", 3)) == []
        assert index.postings.count() == 0


def test_listed_words_are_tokens(rows):
    chars = "".join(map(chr, [*range(1, 0x250), 0x3B1, 0x3C2, 0x3BB, 0x660, 0x966, 0x2160, 0x3042, 0x4E00, 0x20000]))
    texts = [" ".join(chars), chars, ", a,b ", "", None, "--", "ΟΔΟΣ İstanbul"]
    df = rows("doc_id int, text string", *enumerate(texts))
    got = cells(tfidf.term_lists(df, "doc_id", "text").selectExpr("term", "explode(docs)"))
    assert sorted(got) == sorted(cells(tfidf.term_counts(df, "doc_id", "text"), "term", "doc_id"))


# --- substring index ----------------------------------------------------------------------------------

RECORDS = [(1, "油圧ポンプ交換", "PC200"), (2, "Hydraulic pump", None), (3, None, None), (4, "", "é"), (5, "ポンプ", "pc200-8"),
           (6, "ΟΔΟΣ οδός", "x_y%z"), (7, "100% wear", "ab"), (8, "ÉÉ", "Été"), (9, "pump " * 3000, "a\\b")]


@pytest.fixture(scope="module")
def gram_index(spark, tmp_path_factory):
    df = spark.createDataFrame(RECORDS, "id int, work_content string, machine_model string")
    path = str(tmp_path_factory.mktemp("grams"))
    grams.build_grams(df, ["work_content", "machine_model"]).write(path)
    return df, grams.SubstringIndex.read(spark, path)


@pytest.mark.parametrize("needle", ["PUMP", "プ交", "éé", "pc2__-8", "p%mp", "ab", "ΟΔΟΣ", "油圧%交換", "no such", "a\\b"])
def test_index_finds_what_the_scan_finds(gram_index, needle):
    df, index = gram_index
    columns = ["work_content", "machine_model"]
    assert (sorted(cells(search.ilike_search(df, needle, columns=columns, index=index), "id"))
            == sorted(cells(search.ilike_search(df, needle, columns=columns), "id")))
    assert (cells(search.like_search(df, needle, columns=columns, index=index), "id")
            == cells(search.like_search(df, needle, columns=columns), "id"))
    words = f"{needle} pc200"
    assert (sorted(cells(filters.keyword_search(df, words, columns, index), "id"))
            == sorted(cells(filters.keyword_search(df, words, columns), "id")))


def test_index_reads_candidates_only(gram_index):
    _, index = gram_index
    assert sorted(cells(index.holding(["pump"]))) == [(2,), (9,)]
    assert cells(index.holding(["ポンプ", "交換"])) == [(1,)]
    assert index.holding(["no such"]).count() == 0
    assert index.holding(["ab"]) is None and index.holding([]) is None
    assert index.postings.groupBy("gram", "row").count().filter("count > 1").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abc éあい"), max_size=12), st.data())
def test_grams_of_a_part_are_grams_of_the_whole(text, data):
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    assert grams.text_grams(text[a:b]) <= grams.text_grams(text)


@pytest.mark.parametrize("most", [10 ** 6, 0])
def test_long_texts_are_not_sorted(spark, gram_index, monkeypatch, capsys, most):
    df, index = gram_index
    monkeypatch.setattr(grams, "_BROADCAST_ROWS", most)
    monkeypatch.setattr(grams, "RAREST", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.narrowed(df, [["pump"], ["交換"]])
        found.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
        assert sorted(cells(found, "id")) == [(1,), (2,), (9,)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("abc\0\x7f\x80éあ\U0001F600"), max_size=12), max_size=5))
def test_grams_by_codes(texts):
    codes, places = grams.gram_codes(texts)
    assert ({(grams.gram_of(c), p) for c, p in zip(codes.tolist(), places.tolist())}
            == {(g, p) for p, t in enumerate(texts) for g in grams.text_grams(t or "")})


def test_postings_are_shuffled_as_lists(rows, monkeypatch):
    """What is shuffled and sorted are lists of a gram's rows, in bounded parts, not one row per posting."""
    monkeypatch.setattr(grams, "LISTED", 2000)
    df = rows("id int, work_content string", *((i, "a common text あいう") for i in range(1000))).coalesce(1)
    index = grams.build_grams(df, ["work_content"])
    sizes = cells(index.lists.filter("gram = 'com'").selectExpr("size(rows)"))
    assert sum(n for n, in sizes) == 1000 and 1 <= len(sizes) <= 20
    assert cells(index.frequencies.filter("gram = 'いう'"), "rows") == [(1000,)]


def test_stored_gram_lists_are_small(spark, tmp_path):
    """What is shuffled and stored of a posting is a small gap, not a row's id."""
    rand = random.Random(3)
    df = spark.createDataFrame([(10 ** 12 + 7 * i, " ".join(rand.choices(["油圧ポンプ", "abcde", "pump", "wear", "x1 y2"], k=3)))
                                for i in range(4000)], "id long, work_content string").coalesce(1)
    index = grams.build_grams(df, ["work_content"])
    assert dict(index.lists.dtypes)["rows"] == "array<smallint>"
    index.write(str(tmp_path))
    stored = sum(f.stat().st_size for f in tmp_path.rglob("lists/*.parquet"))
    assert stored < 2 * grams.SubstringIndex.read(spark, str(tmp_path)).postings.count()


def test_chunks_do_not_change_what_is_held(spark, rows, gram_index, monkeypatch):
    df, index = gram_index
    monkeypatch.setattr(grams, "LISTED", 10)
    monkeypatch.setattr(grams, "_STEP", 2)
    small = grams.build_grams(df.repartition(2), ["work_content", "machine_model"])
    for pieces in (["pump"], ["ポンプ", "交換"], ["no such"], ["pc200"]):
        assert sorted(cells(small.holding(pieces))) == sorted(cells(index.holding(pieces)))
    assert sorted(cells(small.postings)) == sorted(cells(index.postings))
    assert sorted(cells(small.frequencies)) == sorted(cells(index.frequencies))
    assert small.lists.select("chunk").distinct().count() > 3
    none = grams.build_grams(rows("id int, work_content string").limit(0), ["work_content"])
    assert none.postings.count() == 0 and none.holding(["pump"]).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 32767), max_size=8).map(sorted), max_size=5))
def test_places_of_gaps(lists):
    gaps = pa.array([np.diff(x, prepend=0).tolist() if x else [] for x in lists], pa.list_(pa.int16()))
    assert grams.places_of(gaps).tolist() == [p for x in lists for p in x]


# --- many keywords ------------------------------------------------------------------------------------

def test_many_keywords_count_as_few(rows):
    words = [f"k{i}" for i in range(40)] + ["Pump", "pump", "ポンプ", "é", "k1"]
    df = rows("id int, work_content string, machine_model string", *((i, a, b) for i, a, b in RECORDS),
              (20, "K1 k11 pump ÉK39", "k2k3k4"), (21, "k", None))
    weights = {"work_content": 1.0, "machine_model": 0.5}
    many = df.withColumn("r", relevance(weights, words)).withColumn(
        "any", any_keyword([df.work_content, df.machine_model], words)).collect()
    for row in many:
        scored = sum(w * sum(x.lower() in (row[c] or "").lower() for x in words) for c, w in weights.items())
        assert row["r"] == scored and row["any"] == (scored > 0)
    got = cells(search.relevance_search(df, " ".join(words), ["id"]), "id", "relevance")
    assert got == sorted(((r["id"], r["r"]) for r in many if r["r"] > 0), key=lambda x: (-x[1], x[0]))
    assert sorted(cells(filters.keyword_search(df, " ".join(words)), "id")) == sorted((i,) for i, _ in got)


def test_columns_share_a_python_worker(rows, capsys):
    df = rows("id int, work_content string, machine_model string", (1, "k1", "k2"))
    words = [f"k{i}" for i in range(40)]
    search.relevance_search(df, " ".join(words), ["id"]).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") <= 2       # of the filter and of the result, not one per column
