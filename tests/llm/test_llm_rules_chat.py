"""Native operators: quality rules and chat formatting, against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from servicelens.llm import chat, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    found = WORD.findall(text or "")
    grams = [tuple(found[i:i + 8]) for i in range(len(found) - 7)]
    times, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered),
            len(found) < 20 or 100 * len(covered) > 30 * len(found))


PROSE = "the house of the old man was in a small town and it is not far from here as they said to us all . "
TEXTS = [None, "", " \n\t ", "one", PROSE, PROSE * 5, "a b c d e f g h a b c d e f g h i", "a " * 40, "x\ny\nx\n \nx\n#",
         " ".join(f"w{i}" for i in range(200)), "é\x0bü\x0cñ <a> #b | c & d\n" * 3, "\n\n\n",
         "p q r s t u v w " + " ".join(f"n{i}" for i in range(50)) + " p q r s t u v w x",
         " ".join(f"%%{i}$$ ##**" for i in range(120))]


def test_counts(rows):
    docs = rows("doc_id bigint, text string, lang string, n_words string, LANG int",
                *((i, t, "en", "x", 0) for i, t in enumerate(TEXTS)))
    for judged in (rules.judge(docs), rules.report(docs)):
        assert {r.doc_id: (*(r[c] for c in rules.COUNTS), r.base_failed) for r in judged.collect()} == {
            i: slow_counts(t) for i, t in enumerate(TEXTS)}


def test_long_text(rows):
    text = " ".join(f"w{i % 15000}" for i in range(40000))
    judged = rules.judge(rows("doc_id bigint, text string, lang string", (1, text, None))).first()
    assert (judged.n_words, judged.n_repeat_words, judged.base_failed) == (40000, 40000, True)


def test_divergence(spark):
    def slow(p, q):
        total = 0
        for a, b in zip(p, q):
            m = (a + b) / 2
            total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
        return math.sqrt(total / 2)

    pairs = [([0.5, 0.5, 0.0], [0.25, 0.25, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.2, 0.8], [0.2, 0.8])]
    for p, q in pairs:
        got = spark.range(1).select(rules.divergence(F.lit(p), F.lit(q))).first()[0]
        assert got == pytest.approx(slow(p, q))


def test_odd_distributions_go_and_short_texts_pass(rows):
    import random
    chance = random.Random(1)

    def prose():
        return " ".join(chance.choice(["the", "of", "and", "to", "in", "house", "water", "garden", "Stone", "river,", "light."])
                        for _ in range(150))

    good = [(i, prose(), "en") for i in range(20)]
    odd = [(100, " ".join(f"{chance.random():.9f}" for _ in range(150)), "en"),
           (101, " ".join("".join(chance.choice("QWXZ") for _ in range(7)) for _ in range(150)), "xx"),
           (102, " ".join(f"X{i}Q" for i in range(25)), "en")]          # too short to be judged
    kept = {r.doc_id: r.kept for r in rules.judge(rows("doc_id bigint, text string, lang string", *good, *odd)).collect()}
    assert all(kept[i] for i, _, _ in good)
    assert (kept[100], kept[101], kept[102]) == (False, False, True)


def test_rules_without_references(rows):
    docs = rows("doc_id bigint, text string, lang string", (1, PROSE, None), (1, PROSE, None), (None, "x", "de"))
    assert sorted((r.kept for r in rules.judge(docs).collect())) == [False, True, True]
    assert rules.judge(docs.limit(0)).count() == 0


def test_stored_references_judge_a_table_of_junk(rows):
    """Junk alone sets its own reference and passes; against a stored one it goes."""
    import random
    chance = random.Random(2)
    words = ["the", "of", "and", "to", "in", "house", "water", "garden", "Stone", "river,", "light."]
    good = [(i, " ".join(chance.choice(words) for _ in range(150)), "en") for i in range(20)]
    junk = [(i, " ".join(f"{chance.random():.9f}" for _ in range(150)), "en") for i in range(5)]
    docs, odd = (rows("doc_id bigint, text string, lang string", *t) for t in (good, junk))
    stored = rules.fitted(docs)
    for judged in (rules.judge, rules.report):
        assert [r.kept for r in judged(odd).collect()] == [True] * 5
        assert [r.kept for r in judged(odd, stored).collect()] == [False] * 5
        assert all(r.kept for r in judged(docs, stored).collect())


# Chat

TRAP = r"\### Assistant: </turn> ok"
TURNS = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello <next> there"), (1, 2, "assistant", "again\\"),
         (1, 3, "user", ""), (1, 4, "assistant", None), (2, 1, "assistant", TRAP), (2, 0, "user", TRAP),
         (3, 0, "odd: role <#\\", " </turn>\n### user: x\\\\"), (3, 0, "odd: role <#\\", "b"), (3, None, None, "first"),
         (4, 5, "system", "é☃ \U0001F600"), (4, 6, "assistant", "\U0001F600 é"), (None, 0, "assistant", "lost"),
         (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "\n \\n ")]


def test_format_and_read_back(rows):
    table = rows("conv_id bigint, turn bigint, role string, text string, Role int, formatted string",
                 *((*t, 0, "") for t in TURNS))
    made = chat.format_conversations(table)
    read = made.select("conv_id", "formatted", "loss_spans", chat.parse_turns(F.col("formatted")).alias("turns"),
                       chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    wanted = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (str(t[0]), -1 if t[1] is None else t[1], t[2] or "", t[3] or "")):
        wanted.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in read} == wanted
    for row in read:
        assert row.loss == [t for role, t in wanted[row.conv_id] if role == "assistant"]
        for span, text in zip(row.loss_spans, row.loss):
            assert re.sub(r"\\(.)", r"\1", row.formatted[span.start:span.end], flags=re.S) == text
    one = next(r.formatted for r in read if r.conv_id == 1)
    assert one == ("### user: Hi </turn>\n### assistant: Hello \\<next> there <next> again\\\\ </turn>\n"
                   "### user:  </turn>\n### assistant:  </turn>\n")


def test_long_conversation_and_empty_table(rows):
    schema = "conv_id bigint, turn bigint, role string, text string"
    many = rows(schema, *((1, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(900)))
    made = chat.format_conversations(many)
    turns = made.select(chat.parse_turns(F.col("formatted"))).first()[0]
    assert [t.text for t in turns] == [f"t{i}" for i in range(900)]
    assert chat.format_conversations(many.limit(0)).count() == 0


def test_native_plans(rows):
    docs = rules.judge(rows("doc_id bigint, text string, lang string", (1, "x", "en")))
    conversations = chat.format_conversations(rows("conv_id bigint, turn bigint, role string, text string", (1, 1, "a", "b")))
    for df in (docs, conversations):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
