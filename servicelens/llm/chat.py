"""Chat formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn (then role and text, so ties
are stable). Adjacent turns of one role are merged by an array aggregation into a block, and the
blocks are concatenated:

    ### role: first text <next> second text </turn>

Inside roles and texts every backslash, `#` and `<` (in roles `:` too) gets a backslash in front, so
no control string can stand in them, and taking the backslashes out gives back each text. The loss
spans mark the text of every assistant turn, in code points of the formatted string, end exclusive.

Nulls and special cases: null texts and roles are empty, a null turn comes first, rows without a
conversation id form one conversation with a null id, equal rows are turns of their own, and an empty
table gives no rows. Other columns are ignored. One conversation is one row, so its size is limited by
what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import only
from servicelens.llm.rules import let

# The template.
OPEN, COLON, NEXT, CLOSE = "### ", ": ", " <next> ", " </turn>\n"
LOSS_ROLE = "assistant"

_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"


def escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{more}])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merged(turns: Column) -> Column:
    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(last.role.alias("role"), F.array_append(last.texts, turn.text).alias("texts"))
        opened = F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1)).role == turn.role)
        return F.when(same, F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), F.array(longer))
                      ).otherwise(F.array_append(blocks, opened))

    return F.aggregate(turns, F.array().cast(_BLOCKS), add)


def _pieces(blocks: Column) -> Column:
    """One struct per turn: what stands before its text, the text, what stands behind, and the role."""
    def of_block(block: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(block.role, ":"), F.lit(COLON))
        return F.transform(block.texts, lambda text, i: F.struct(
            F.when(i == 0, head).otherwise(NEXT).alias("before"),
            escaped(text).alias("body"),
            F.when(i == F.size(block.texts) - 1, CLOSE).otherwise("").alias("behind"),
            block.role.alias("role")))

    return F.flatten(F.transform(blocks, of_block))


def _spans(pieces: Column) -> Column:
    def add(state: Column, piece: Column) -> Column:
        start = state.at + F.length(piece.before)
        end = start + F.length(piece.body)
        marked = F.array_append(state.spans, F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + F.length(piece.behind)).alias("at"),
            F.when(piece.role == LOSS_ROLE, marked).otherwise(state.spans).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(_SPANS)
    return F.aggregate(pieces, empty, add, lambda state: state.spans)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted and loss_spans (array of start and end)."""
    texts = only(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("turn"))
    turns = texts.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = turns.select("conv_id", _pieces(_merged(F.col("turns"))).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p.before, p.body, p.behind)), "")
    return pieces.select("conv_id", whole.alias("formatted"), _spans(F.col("pieces")).alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    shape = rf"(?s)^{OPEN}((?:[^\\:]|\\.)*){COLON}(.*)$"

    def of_block(block: Column) -> Column:
        role = unescaped(F.regexp_extract(block, shape, 1))
        return F.transform(F.split(F.regexp_extract(block, shape, 2), NEXT),
                           lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    blocks = F.split(formatted, CLOSE)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), of_block))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped text of every span."""
    return let(formatted, lambda f: F.transform(spans, lambda s: unescaped(
        F.substring(f, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))))
