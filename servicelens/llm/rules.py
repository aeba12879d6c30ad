"""Quality rules by distribution divergence, in Spark expressions only.

Each text has two histograms: characters by class, and common words of its language. A reference for
a language is the mean of both over all documents of that language (long enough ones), so it is as
complete as the corpus; it takes one pass and comes out as one short row per known language, at most four. A text
is rejected when its Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) from its
reference is above a limit. A text too short for a stable histogram is not judged by it, and a text
in a language without a reference is judged by the nearest reference.

Before that stand two base rules: fewer than 20 words, or more than 30 % of the words in repeated
windows of eight.

Nulls and special cases: a null text is an empty one and fails the base rules. Repeated rows are
judged alike. Without any reference (an empty table, no known language) only the base rules count.
All columns are kept; result columns replace ones of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import durable, only, shielded

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30              # per cent
CHARS_GUARD = 200               # characters a text must have to be judged by its character classes
WORDS_GUARD = 60                # words ... by its common words
CHARS_LIMIT = 0.30
WORDS_LIMIT = 0.45

# Very common words of each language.
COMMON_WORDS = {
    "en": ("the of and to in a is that for it as was with be by on not this are or from at an have "
           "which").split(),
    "fr": ("de la le les et des en un une du que est pour qui dans par plus pas au sur ne se ce il "
           "avec").split(),
    "de": ("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es "
           "an werden aus").split(),
    "es": ("de la que el en y a los del se las por un para con no una su al lo como más es sus "
           "le").split(),
}

# Character classes as regular expressions of all characters outside of them. Blanks
# and whatever is left over are two classes more.
CLASSES = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "stop": r"[^.,;:!?'\"()\-]+",
    "symbol": "[^#*$%&|<>@^~_=+/{}]+",
    "beyond": r"[\x00-\x7F]+",
}

_REFERENCES = ("array<struct<reference_lang:string,reference_chars:array<double>,"
               "reference_words:array<double>>>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once per row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _only_matching(text: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(text, outside, ""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of eight that stands in the text twice or more."""
    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window),
                           lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    def covered(places: Column) -> Column:
        follows = F.concat(F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1))),
                           F.array(F.element_at(places, -1) + window))
        steps = F.zip_with(places, follows, lambda a, b: F.least(b - a, F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    def counted(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twice(p: Column) -> Column:
            alike = F.filter(p, lambda x, i: (x.g == F.get(p, i - 1).g) | (x.g == F.get(p, i + 1).g))
            return let(F.sort_array(F.transform(alike, lambda x: x.i)), covered)

        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(placed, twice)).otherwise(0)

    return F.when(F.size(words) >= window,
                  let(let(F.transform(words, lambda w: F.xxhash64(w)), hashed), counted)).otherwise(0)


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _words, and _word_chars, the characters in them."""
    return docs.withColumn("_words", words_of(F.coalesce("text", F.lit("")))).withColumn(
        "_word_chars", F.length(F.array_join("_words", "")))


def with_counts(worded: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return worded.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.col("_word_chars").cast("long"),
        "n_symbols": _only_matching(text, r"[^#*$%&|<>]+").cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
    })


def _shares(counts: Column) -> Column:
    """Counts as shares of their sum."""
    total = F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, c: a + c), F.lit(1.0))
    return let(total, lambda t: F.transform(counts, lambda c: c / t))


def _class_counts(text: Column) -> Column:
    parts = [_only_matching(text, r).cast("double") for r in CLASSES.values()]
    parts.append((F.length(text) - F.col("_word_chars")).cast("double"))
    return let(F.array(*parts), lambda p: F.concat(p, F.array(
        F.length(text) - F.aggregate(p, F.lit(0.0), lambda a, c: a + c))))


def _word_counts(words: Column, lang: str) -> Column:
    """How often each common word of the language occurs, in lower case or capitalized; the last
    number counts all other words."""
    common = COMMON_WORDS[lang]
    hits = F.transform(F.filter(words, lambda w: w.isin(*common, *(c.capitalize() for c in common))),
                       F.lower)
    known = F.array(*(F.lit(c) for c in common))

    def counts(found: Column) -> Column:
        each = F.transform(known, lambda c: (F.size(found) - F.size(F.array_remove(found, c))).cast("double"))
        return F.concat(each, F.array((F.size(words) - F.size(found)).cast("double")))

    return let(hits, counts)


def measure(docs: DataFrame) -> DataFrame:
    """The documents with the counts, `_length`, `_chars` (shares of the classes) and, by language,
    `_words_<lang>` (shares of its common words) where the text may be in it."""
    text = F.coalesce("text", F.lit(""))
    unknown = ~F.coalesce(F.col("lang").isin(*COMMON_WORDS), F.lit(False))
    return with_counts(with_words(docs)).withColumns({
        "_length": F.length(text),
        "_chars": _shares(_class_counts(text)),
        **{f"_words_{lang}": F.when(unknown | (F.col("lang") == lang),
                                    _shares(_word_counts(F.col("_words"), lang)))
           for lang in COMMON_WORDS}}).drop("_words", "_word_chars")


def references(measured: DataFrame) -> DataFrame:
    """One row per known language: reference_lang, reference_chars and reference_words."""
    own = F.coalesce(*(F.when(F.col("lang") == x, F.col(f"_words_{x}")) for x in COMMON_WORDS))
    shares = measured.where(F.col("lang").isin(*COMMON_WORDS) & (F.col("_length") >= CHARS_GUARD)
                            & (F.col("n_words") >= WORDS_GUARD)).select("lang", "_chars", own.alias("_own"))
    size = 1 + max(map(len, COMMON_WORDS.values()))
    means = shares.groupBy("lang").agg(
        F.array(*(F.avg(F.get("_chars", F.lit(i))) for i in range(len(CLASSES) + 2))).alias("reference_chars"),
        F.array(*(F.avg(F.get("_own", F.lit(i))) for i in range(size))).alias("reference_words"))
    return means.withColumnRenamed("lang", "reference_lang")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, 0 to 1."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2, F.lit(0.0)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "char_distance", "word_distance", "kept")


def verdicts(measured: DataFrame, reference: DataFrame, chars_limit: float = CHARS_LIMIT,
             words_limit: float = WORDS_LIMIT) -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept to measured documents.

    The distances are null where a guard holds or no reference exists.
    """
    listed = F.array(*(F.struct(
        F.lit(r.reference_lang).alias("reference_lang"), F.lit(r.reference_chars).alias("reference_chars"),
        F.lit(r.reference_words).alias("reference_words")) for r in reference.collect())).cast(_REFERENCES)

    def least(distance: Callable[[Column], Column]) -> Column:
        own = F.exists("_references", lambda r: r.reference_lang == F.col("lang"))
        fit = F.filter("_references", lambda r: ~F.coalesce(own, F.lit(False))
                       | (r.reference_lang == F.col("lang")))
        return F.array_min(F.transform(fit, distance))

    def words_for(r: Column) -> Column:
        mine = F.coalesce(*(F.when(r.reference_lang == x, F.col(f"_words_{x}")) for x in COMMON_WORDS))
        return divergence(mine, r.reference_words)

    distances = measured.withColumn("_references", listed).withColumns({
        "char_distance": F.when(F.col("_length") >= CHARS_GUARD,
                                least(lambda r: divergence(F.col("_chars"), r.reference_chars))),
        "word_distance": F.when(F.col("n_words") >= WORDS_GUARD, least(words_for)),
        "base_failed": (F.col("n_words") < LEAST_WORDS)
        | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    })
    near = (F.coalesce(F.col("char_distance") <= chars_limit, F.lit(True))
            & F.coalesce(F.col("word_distance") <= words_limit, F.lit(True)))
    return distances.withColumn("kept", ~F.col("base_failed") & near)


def fitted(docs: DataFrame) -> DataFrame:
    """The references of a table, to be stored and given to `judge` or `report` for others: verdicts then
    depend on no other document of the table that is judged."""
    return references(measure(only(docs, "text", "lang")))


def judge(docs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The documents with the counts, base_failed, char_distance, word_distance and kept.

    Without references given, texts are measured twice, for them and for the verdict, and moved nowhere.
    """
    safe, restored = shielded(docs, ("text", "lang"), ADDED)
    measured = measure(safe)
    return restored(verdicts(measured, references(measured) if reference is None else reference))


def report(docs: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """doc_id with what `judge` adds. Measurements are kept in a checkpoint, so texts are read once."""
    measured = durable(measure(only(docs, "doc_id", "text", "lang")).drop("text"))
    return verdicts(measured, references(measured) if reference is None else reference).select("doc_id", *ADDED)
