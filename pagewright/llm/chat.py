"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A conversation is formatted once, as marked turns; every assistant turn becomes an example of its own, which is
a prefix of that text: all turns before as context, the reply as its only trainable span. Examples are kept with
their conversation as spans of its text (`write_examples`), so a conversation of n turns takes n texts of room, not
n*n; `expand` explodes them and cuts each reply out by its loss mask, `materialized` the contexts, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """No "<|" stays in a text: a backslash goes behind the "<" of each "<|", "<\\|", "<\\\\|", ..."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    """A role on one line: "%" and newline as %25 and %0A; null is a lone "%"."""
    plain = escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))
    return F.when(role.isNull(), F.lit("%")).otherwise(plain)


def _unrole(role: Column) -> Column:
    plain = F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return F.when(role != "%", plain)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, examples) from (conv_id, turn, role, text): a row for each conversation.

    examples: array<struct<example, start, end, byte_start, byte_end>>, one for each assistant turn in order;
    `example` is the turn's place from 0, and formatted[start:end] (code points; byte_start and byte_end in its
    UTF-8) its trainable span, the escaped reply. Turns go by turn (nulls first), ties by role and text; rows that
    repeat are turns that repeat. Null text is empty; a null role stays null, a null conv_id is a conversation.
    Other columns play no part. An empty table gives no rows. A conversation is put together in one task.
    """
    own = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    shown = own.withColumn("place", F.row_number().over(order) - 1).withColumn("body", escape(F.col("text")))
    shown = shown.withColumn("shown", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"), "body", F.lit(END)))
    stop = lambda size: (F.sum(size("shown")).over(upto) - F.lit(len(END))).cast("long")
    shown = shown.withColumns({"end": stop(F.char_length), "byte_end": stop(F.octet_length)})
    span = F.struct(F.col("place").alias("example"), (F.col("end") - F.char_length("body")).alias("start"), "end", (F.col("byte_end") - F.octet_length("body")).alias("byte_start"), "byte_end")
    return shown.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "shown"))), lambda t: t["shown"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", span))).alias("examples"),
    )


def write_examples(rows: DataFrame, path: str) -> None:
    """format_conversations(rows) as Parquet files, of which `expand` makes the examples."""
    format_conversations(rows).write.parquet(path)


def read_back(formatted: Column) -> Column:
    """From a formatted text: array<struct<role, text, chars, body>>; chars: code points of the turn with its marks,
    body: those of its escaped text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        body = F.substring(part, line + 1, F.char_length(part) - line - len(END))
        return F.struct(
            _unrole(F.substring(part, F.lit(1), line - 1)).alias("role"), unescape(body).alias("text"), (F.char_length(part) + len(START)).alias("chars"), F.char_length(body).alias("body"),
        )

    return F.transform(parts, turn)


def _cut(formatted: Column, low: Column, high: Column) -> Column:
    """Text between two byte places of a formatted text, which is given in UTF-8: as long to cut as it is long."""
    return F.substring(formatted, (low + 1).cast("int"), (high - low).cast("int")).cast("string")


def expand(formatted: DataFrame, contexts: bool = False) -> DataFrame:
    """(conv_id, example, start, end, reply[, context]) from (conv_id, formatted, examples): an example for each
    assistant turn.

    The example's text is formatted[0:end] (code points): its context before start, and the trainable reply
    from start to end; `reply` is cut out by that mask and unescaped, `context` stays as formatted. Conversations
    without an assistant turn have none.
    """

    def cut(raw: Column) -> Column:
        more = (lambda e: [_cut(raw, F.lit(0), e["byte_start"]).alias("context")]) if contexts else lambda _: []
        return F.transform("examples", lambda e: F.struct(e["example"].alias("example"), e["start"].alias("start"), e["end"].alias("end"), unescape(_cut(raw, e["byte_start"], e["byte_end"])).alias("reply"), *more(e)))

    return formatted.select("conv_id", F.explode(let(F.col("formatted").cast("binary"), cut)).alias("e")).select("conv_id", "e.*")


def materialized(formatted: DataFrame) -> DataFrame:
    """(conv_id, example, context, reply): examples with contexts of their own, n*n texts of room for n turns."""
    return expand(formatted, contexts=True).select("conv_id", "example", "context", "reply")
