"""Text expressions: normalization, tokens, literal and LIKE predicates, composed texts."""

from __future__ import annotations

import json
import string
import unicodedata
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servicelens import fields
from servicelens.functions.automaton import MANY, keywords_held
from servicelens.functions.values import any_of, blank_to_null, named

# ASCII white space and separator controls where they are more than one plain space
_ASCII_RUN = r"[\t-\r\x1C-\x20]{2,}|[\t-\r\x1C-\x1F]"
WORD_RUN = r"([\p{L}\p{N}_]+)"

# Japanese marks, kana and ideographs which NFKC leaves alone and which never merge with a neighbour;
# full-width ASCII and the wide blank become plain ASCII
_STEADY = "\u3001-\u3003\u3005-\u3015\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fff"
_WIDE = "\u3000" + "".join(chr(i) for i in range(0xFF01, 0xFF5F))
_NARROW = " " + "".join(chr(i) for i in range(0x21, 0x7F))
_WORD = rf"[\x00-\x08\x0E-\x1B!-\x7F{_STEADY}]++"
_NORMAL = rf"\A(?:{_WORD}(?: {_WORD})*+)?\z"
_EVERYDAY = rf"\A[\x00-\x7F{_STEADY}\u3000\uff01-\uff5e]*+\z"


@F.pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    # split() without arguments knows all Unicode white space
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()),
                     na_action="ignore")


def normalize_text(c: Column) -> Column:
    """NFKC, trimmed, white space collapsed; null stays null.

    Spark has no Unicode normalization of its own. ASCII text needs none, so only the other rows
    carry their text over to Python.
    """
    beyond_ascii = F.octet_length(c) != F.length(c)
    plain = F.trim(F.regexp_replace(c, _ASCII_RUN, " "))
    return F.when(beyond_ascii, _normalized(F.when(beyond_ascii, c))).otherwise(plain)


def normalize_everyday(c: Column) -> Column:
    """`normalize_text` of the characters that most cells are made of: ASCII, full-width ASCII, kana and
    ideographs; null for any other text. Needs no Python."""
    narrow = F.translate(c, _WIDE, _NARROW)
    return F.when(c.rlike(_NORMAL), c).when(
        c.rlike(_EVERYDAY), F.trim(F.regexp_replace(narrow, _ASCII_RUN, " ")))


@F.pandas_udf(T.StringType())
def _normalized_cells(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: json.dumps([t if t is None else " ".join(unicodedata.normalize("NFKC", t).split())
                                            for t in json.loads(row)]), na_action="ignore")


def normalize_cells(cells: Column) -> Column:
    """`normalize_text` of every cell of an array, or null for a null array. The arrays travel as JSON, as
    Spark measures a batch of lists anew for each row that it adds to it."""
    return F.from_json(_normalized_cells(F.to_json(cells)), "array<string>")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, as an array."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RUN), F.lit(0))


def contains_text(c: Column, needle: str) -> Column:
    """Literal, case-insensitive containment."""
    return F.contains(F.lower(c), F.lower(F.lit(needle)))


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive regular expression, anywhere in the text."""
    return c.rlike("(?iu)" + pattern)


def _like_argument(query: str) -> str:
    return "%" + query.replace("\\", "\\\\") + "%"


def ilike_any(columns: Sequence[Column], query: str) -> Column:
    """`ILIKE '%query%'` on any column; `%` and `_` in the query are wildcards."""
    return any_of(c.ilike(_like_argument(query)) for c in columns)


def like_any(columns: Sequence[Column], query: str) -> Column:
    """`LIKE '%query%'` on any column, ignoring the case of ASCII letters only."""
    def fold(c: Column) -> Column:
        return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)

    folded = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return any_of(fold(c).like(_like_argument(folded)) for c in columns)


def keywords(query: str) -> list[str]:
    return query.split()


def any_keyword(columns: Sequence[Column], words: Sequence[str]) -> Column:
    """True when any keyword occurs literally in any column."""
    if len(words) >= MANY:
        return any_of(keywords_held(c, words) > 0 for c in columns)
    return any_of(contains_text(c, w) for c in columns for w in words)


def relevance(weighted: Mapping[str, float], words: Sequence[str]) -> Column:
    """Sum over (column, keyword) hits of the column's weight."""
    score = F.lit(0.0)
    for name, weight in weighted.items():
        if len(words) >= MANY:
            score = score + keywords_held(named(name), words) * weight
            continue
        for w in words:
            hit = F.coalesce(contains_text(named(name), w), F.lit(False))
            score = score + F.when(hit, weight).otherwise(0.0)
    return score


def labelled(labels: Mapping[str, str], units: Mapping[str, str] | None = None,
             blank_is_null: bool = False) -> Column:
    """`label: value | label: value`, skipping missing values."""
    parts = []
    for name, label in labels.items():
        value = F.col(name).cast("string")
        if blank_is_null:
            value = blank_to_null(value)
        parts.append(F.concat(F.lit(f"{label}: "), value, F.lit((units or {}).get(name, ""))))
    return F.concat_ws(" | ", *parts)


def has_any(names: Iterable[str]) -> Column:
    """True when any of the columns has a value, i.e. when the text made of them is not empty."""
    return any_of(F.col(n).isNotNull() for n in names)


def record_text() -> Column:
    """Full searchable text of a standard record."""
    units = {name: fields.HOUR_UNIT for name in fields.NUMERIC_RECORD_COLUMNS}
    return labelled(fields.RECORD_LABELS, units)


def light_text() -> Column:
    """Short searchable text: model, work, malfunction, part."""
    return labelled(fields.LIGHT_LABELS)


def record_snippet() -> Column:
    return labelled(fields.RECORD_SNIPPET_LABELS, blank_is_null=True)


def light_snippet() -> Column:
    return labelled(fields.LIGHT_SNIPPET_LABELS, blank_is_null=True)


def metadata_json(columns: Sequence[str]) -> Column:
    """JSON object of the columns; missing values are left out."""
    return F.to_json(F.struct(*columns))
