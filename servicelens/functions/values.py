"""Column expressions that turn raw cells into typed and derived values.

All of them are built-in Spark expressions, so they stay inside code generation, and all of them
yield null (never an error) for a cell they cannot read, whether ANSI mode is on or off.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from servicelens import fields

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_NAME = ("(?i)(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?"
         "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
_MONTH_FIRST = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)"
_DAY_NAME = rf"(?i)^\s*(\d{{1,2}})[- ]{_NAME}[-, .]+(\d{{4}})((?:\s.*)?)$"
_NAME_DAY = rf"(?i)^\s*{_NAME}\.?[ -](\d{{1,2}})(?:,? |-)(\d{{4}})((?:\s.*)?)$"
_YEAR_FIRST = r"^\s*\d{4}"
_DAY = r"^\s*(\d{4})(?:[/.年](\d{1,2})[/.月](\d{1,2})日?|(\d{2})(\d{2})(?!\d))"


def named(name: str) -> Column:
    """The column of exactly this name; headings may hold dots and other marks."""
    return F.col("`" + name.replace("`", "``") + "`")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def any_of(predicates: Iterable[Column]) -> Column:
    """OR of the predicates; a null predicate counts as false, no predicate at all is false."""
    out = F.lit(False)
    for p in predicates:
        out = out | F.coalesce(p, F.lit(False))
    return out


def words_pattern(words: Sequence[str]) -> str:
    """A pattern that matches any of the words literally, in Java and in RE2."""
    special = set("\\.^$|?*+()[]{}")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not wholly a decimal number is null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def to_timestamp(c: Column) -> Column:
    """Text to a zone-free timestamp: `2024-1-5`, `2024/1/5 9:30`, `2024年1月5日`, `20240105`, month
    first as in `1/5/2024`, and month names as in `05-Jan-2024` or `January 5, 2024 9:30`."""
    def month(name: Column) -> Column:
        place = F.instr(F.lit(_MONTHS), F.lower(F.substring(name, 1, 3)))
        return ((place + 2) / 3).cast("int").cast("string")

    def from_parts(pattern: str, named_month: int, day: int) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(c, pattern, i)

        return F.when(c.rlike(pattern), F.concat(
            part(3), F.lit("-"), month(part(named_month)), F.lit("-"), part(day), part(4)))

    year_first = F.regexp_replace(c, _DAY, "$1-$2$4-$3$5")
    written = (F.when(c.rlike(_YEAR_FIRST), year_first)     # most dates; fits none of the other patterns
               .when(c.rlike(_MONTH_FIRST), F.regexp_replace(c, _MONTH_FIRST, "$3-$1-$2"))
               .when(c.rlike(_DAY_NAME), from_parts(_DAY_NAME, 2, 1))
               .when(c.rlike(_NAME_DAY), from_parts(_NAME_DAY, 1, 2))
               .otherwise(year_first))
    return written.try_cast("timestamp_ntz")


def duration_days(c: Column) -> Column:
    """Days in a duration text: months count 30 days, then days, then any number."""
    def first(pattern: str) -> Column:
        return blank_to_null(F.regexp_extract(c, pattern, 1)).try_cast("double")

    return F.coalesce(first(r"(\d+)カ月") * 30, first(r"(\d+)日"), first(r"(\d+)"))


def hour_bin(c: Column) -> Column:
    """Label of the usage-hour band; unreadable or missing readings get their own band."""
    out = F.when(c.isNull() | F.isnan(c), fields.UNKNOWN_BIN)
    for upper, label in fields.HOUR_BINS:
        out = out.when(c < upper, label)
    return out.otherwise(fields.LAST_HOUR_BIN)


def malfunction_flag(columns: Sequence[Column],
                     exempt: Sequence[str] = fields.FLAG_EXEMPT_WORDS) -> Column:
    """1 when any of the columns holds text that mentions none of the exempt words."""
    pattern = words_pattern(exempt)
    return any_of((c != "") & ~c.rlike(pattern) for c in columns).cast("int")


def extract_code(columns: Sequence[Column], pattern: str = fields.BULLETIN_PATTERN) -> Column:
    """First match of the pattern, looking through the columns in turn; null if there is none."""
    return F.coalesce(*(blank_to_null(F.regexp_extract(c, pattern, 0)) for c in columns))


def percent(part: Column, whole: Column) -> Column:
    """part/whole in percent with two decimals, halves to even."""
    return F.bround(part / whole * 100, 2)
