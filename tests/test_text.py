import random
import re
import unicodedata

import pyarrow as pa
from conftest import cells
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from servicelens.functions import text
from servicelens.functions.batches import sliced_arrays
from servicelens.functions.chunking import _pieces, chunk_documents, split_text
from servicelens.functions.fuzzy import can_reach, fuzzy_match, fuzzy_score, partial_scores
from servicelens.operators.clean import normalize_texts


def test_normalize(rows):
    inputs = ["ＫＸ－０８０　ﾎﾟﾝﾌﾟ ", None, "  a \t b\n", "a b", "", "   ", "a\x1cb", "é  x", " ㌔ "]
    df = rows("i int, v string", *enumerate(inputs))
    got = [r[0] for r in df.orderBy("i").select(text.normalize_text(F.col("v"))).collect()]
    want = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split())
            for t in inputs]
    assert got == want
    assert got[:2] == ["KX-080 ポンプ", None]


def test_normalize_touches_text_columns_only(rows):
    df = rows("a string, b int, c string", ("Ａ", 1, " x "))
    assert cells(normalize_texts(df)) == [("A", 1, "x")]


def test_everyday_cells_need_no_python(rows):
    inputs = ["ＫＸ－０８０　ポンプ\t 漏れ", None, "", " ", "a b", " a", "a  b", "a\nb", "a\x1fb", "定期点検、ヾ々〆", "ｶﾞ①",
              "か\u3099", "é", "a\u00a0b", "㌔ x", "～！　", "\u3000", "a\x00b", "[\"x\", null]", "x" * 9000 + " y" * 9000]
    want = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in inputs]
    df = rows("i int, v string", *enumerate(inputs)).orderBy("i")
    easy = [r[0] for r in df.select(text.normalize_everyday(F.col("v"))).collect()]
    assert [i for i, e in enumerate(easy) if e is None] == [1, 10, 11, 12, 13, 14]
    assert all(e is None or e == w for e, w in zip(easy, want))
    pairs = list(zip(inputs, reversed(inputs)))
    got = normalize_texts(rows("a string, `b.c` string, i int", *((a, b, i) for i, (a, b) in enumerate(pairs))))
    assert cells(got.orderBy("i"), "a", "`b.c`") == list(zip(want, reversed(want)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_normalized") == plan.count("_normalized_cells")       # one pass for all columns


def test_steady_characters_are_those_that_nfkc_leaves(rows):
    steady = re.compile(f"[{text._STEADY}]")
    marks = {unicodedata.normalize("NFD", chr(i))[1:2] for i in range(0x110000) if not 0xD800 <= i < 0xE000}
    for c in filter(steady.match, map(chr, range(0x10000))):
        assert unicodedata.normalize("NFKC", c) == c and not c.isspace() and not unicodedata.combining(c)
        assert c not in marks
    assert unicodedata.normalize("NFKC", text._WIDE) == text._NARROW


def test_tokens(rows):
    df = rows("v string", ("機種: U-30 | 作業内容: オイル漏れ修理_x",), ("",))
    assert cells(df.select(text.tokens(F.col("v")))) == [
        (["機種", "u", "30", "作業内容", "オイル漏れ修理_x"],), ([],)]


def test_like_is_blind_to_ascii_case_only(rows):
    df = rows("v string", ("ÉVI a",), ("éVI b",), ("x%y",), ("a\\b",))
    search = lambda q: [r[0] for r in df.filter(text.like_any([F.col("v")], q)).collect()]  # noqa
    assert search("évI") == ["éVI b"]
    assert search("É%A") == ["ÉVI a"]
    assert search("\\") == ["a\\b"]
    assert cells(df.filter(text.ilike_any([F.col("v")], "évi"))) == [("ÉVI a",), ("éVI b",)]


def test_literal_predicates_ignore_case_and_nulls(rows):
    df = rows("a string, b string", ("A.C", None), ("abc", None), (None, "x a.c y"), (None, None))
    got = cells(df.filter(text.any_keyword([F.col("a"), F.col("b")], ["a.c"])))
    assert got == [("A.C", None), (None, "x a.c y")]


def test_composed_texts(rows):
    df = rows("machine_model string, work_content string, malfunction_content string, "
              "parts_name string", ("U-30", None, "", "ポンプ"), (None, None, None, None))
    assert cells(df.select(text.light_text(), text.light_snippet(), text.record_snippet())) == [
        ("機種: U-30 | 不具合内容:  | 交換部品: ポンプ", "機種: U-30 | 部品: ポンプ", "部品: ポンプ"),
        ("", "", "")]
    assert df.filter(text.has_any(df.columns)).count() == 1


def test_metadata_leaves_out_missing_values(rows):
    df = rows("case_no string, category string, row_index int", ("A", None, 3))
    assert df.select(text.metadata_json(df.columns)).first()[0] == '{"case_no":"A","row_index":3}'


# --- fuzzy ------------------------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute_force(a, b):
    a, b = a.lower(), b.lower()
    best = 0.0
    for short, long in ((a, b), (b, a)):
        if 0 < len(short) <= len(long):
            for i in range(1 - len(short), len(long)):
                window = long[max(i, 0):i + len(short)]
                best = max(best, 200 * lcs(short, window) / (len(short) + len(window)))
    return best


def test_fuzzy_scores_match_brute_force():
    rng = random.Random(7)
    word = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    for size in (1, 2, 5, 8, 63, 64, 65, 70):
        needle = word(size, "abcdé漏")
        texts = [word(rng.choice([0, 1, 2, 5, 9, 20, 64, 70]), "abcdé漏xy") for _ in range(15)]
        got = partial_scores(needle, [*texts, None])
        assert all(abs(g - brute_force(needle, t)) < 1e-9 for g, t in zip(got, [*texts, ""]))


def test_fuzzy_in_spark(rows):
    df = rows("i int, v string", (1, "oil leek"), (2, "Big OIL LEAK here"), (3, "pump"), (4, None),
              (5, ""), (6, "oil"))
    scores = dict(cells(df.select("i", fuzzy_score(F.col("v"), "oil leak"))))
    assert scores[1] == 87.5 and scores[2] == 100 and scores[4] is None and scores[5] == 0
    assert scores[6] == 100
    assert [r[0] for r in df.filter(fuzzy_match(F.col("v"), "oil leak")).collect()] == [1, 2, 6]
    other = rows("v string", ("ポンプの異音発生",))
    assert other.filter(fuzzy_match(F.col("v"), "オイルもれ")).count() == 0


def test_fuzzy_prefilter_never_loses_a_match(rows):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(1, 25)))
             for _ in range(400)]
    for needle in ("abcdefg", "aab", "cab dab bag"):
        df = rows("i int, v string", *enumerate(texts))
        kept = {r[0] for r in df.filter(can_reach(F.col("v"), needle)).collect()}
        wanted = {i for i, s in enumerate(partial_scores(needle, texts)) if s > 70}
        assert wanted and wanted <= kept


# --- chunks -------------------------------------------------------------------------------------

words = st.lists(st.sampled_from(["ab", "漏れ", " | ", "。", "、", " ", "x" * 30]), max_size=80)


@given(words, st.integers(10, 60), st.integers(0, 9))
def test_pieces_rebuild_the_text_and_chunks_fit(parts, size, overlap):
    original = "".join(parts)
    pieces = _pieces(original, size, [" | ", "。", "、", " "])
    assert "".join(pieces) == original and all(len(p) <= size for p in pieces)
    chunks = split_text(original, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    position = 0
    for c in chunks:            # every chunk is a stretch of the text, in order
        position = original.find(c, max(0, position - size))
        assert position >= 0
    kept = "".join("".join(chunks).split())
    assert len(kept) >= len("".join(original.split()))


def test_chunk_rules():
    assert split_text("short") == ["short"]
    assert split_text("  ") == []
    assert [len(c) for c in split_text("x" * 1200)] == [500, 500, 200]
    text_ = "あ" * 480 + "。" + "い" * 30 + "。" + "う" * 300
    assert split_text(text_) == ["あ" * 480, "。" + "い" * 30 + "。" + "う" * 300]
    tail = split_text("a" * 460 + " " + "b" * 30 + " " + "c" * 100)
    assert tail == ["a" * 460 + " " + "b" * 30, "b" * 30 + " " + "c" * 100]


def test_chunk_table(rows):
    df = rows("id int, v string, tag string", (1, "a b", "p"), (2, "x" * 600, "q"), (3, None, "r"),
              (4, " ", "s"))
    got = cells(chunk_documents(df, "v").orderBy("id", "chunk_index"))
    assert got == [(1, "p", 0, "a b"), (2, "q", 0, "x" * 500), (2, "q", 1, "x" * 100)]


def test_texts_become_objects_in_bounded_parts():
    array = pa.array(["x" * 1000] * 500 + [None, "", "y" * 30_000])
    parts = list(sliced_arrays(array, 20_000))
    assert pa.concat_arrays(parts).equals(array)
    assert len(parts) > 20 and all(len(p) <= 20 for p in parts)
    assert list(sliced_arrays(array.slice(0, 0))) == []
