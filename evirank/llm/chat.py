"""Chat formatting: turns of a conversation to one training text with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evirank.llm.common import let

#: The template. `<` never occurs inside an escaped role or text, so each marker is unambiguous.
OPEN, CLOSE, JOIN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"
#: Escapes, in the order of encoding: control strings of this and of bracket templates can't survive inside a text.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _formatted(turns: Column) -> Column:
    """Sorted turn structs -> struct(formatted, loss). One aggregate walks the turns: a turn of the same role as the one before
    joins its block, any other closes the block and opens the next; offsets of assistant texts are kept on the way."""
    start = F.struct(
        F.lit(None).cast("string").alias("role"), F.lit(0).cast("bigint").alias("at"),
        F.array().cast("array<string>").alias("parts"), F.array().cast("array<struct<start:bigint,chars:bigint>>").alias("loss"))

    def step(acc: Column, turn: Column) -> Column:
        same = acc["role"].eqNullSafe(turn["role"])
        head = F.concat(F.when(acc["role"].isNull(), F.lit("")).otherwise(F.lit(CLOSE)), F.lit(OPEN), turn["role"], F.lit("\n"))
        mark = F.when(same, F.lit(JOIN)).otherwise(head)
        begin = acc["at"] + F.length(mark)
        chars = F.length(turn["text"]).cast("bigint")
        spans = F.when(turn["role"] == "assistant", F.concat(acc["loss"], F.array(F.struct(begin.alias("start"), chars.alias("chars"))))).otherwise(acc["loss"])
        return F.struct(turn["role"].alias("role"), (begin + chars).alias("at"),
                        F.concat(acc["parts"], F.array(mark, turn["text"])).alias("parts"), spans.alias("loss"))

    return F.aggregate(turns, start, step, lambda acc: F.struct(
        F.concat(F.array_join(acc["parts"], ""), F.lit(CLOSE)).alias("formatted"), acc["loss"].alias("loss")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, ..) -> (conv_id, formatted, loss array<struct<start, chars>>), one row per conversation.

    Turns are ordered by turn (nulls first), then role and text, so ties and repeated rows have one result; adjacent turns
    of one role share a block. Null role or text is empty; a null conv_id is a conversation of its own. `loss` holds the
    code-point spans (from 0) of the assistant texts in `formatted`. Other columns are ignored; an empty table gives no rows.
    A conversation is one row of the result, so its turns meet in one task by definition; nothing else does.
    """
    ready = turns.select(
        "conv_id", "turn", F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;")).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"))
    return (ready.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
            .select("conv_id", _formatted(F.col("turns")).alias("f")).select("conv_id", "f.formatted", "f.loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>, unescaped."""
    blocks = F.slice(F.split(formatted, r"<\|im_end\|>\n", -1), 1, F.size(F.split(formatted, r"<\|im_end\|>\n", -1)) - 1)

    def block(b: Column) -> Column:
        role = unescape(F.replace(F.substring_index(F.substring(b, len(OPEN) + 1, 1 << 30), "\n", 1), F.lit("&#10;"), F.lit("\n")))
        body = F.substring(b, F.locate("\n", b) + 1, F.length(b))
        return let(role, lambda r: F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, block))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int"))))


def digest(formatted: DataFrame) -> DataFrame:
    """Read back what was written: counts and hashes per conversation."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            F.array_join(loss_texts(F.col("formatted"), F.col("loss")), "").alias("loss_text"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(plain.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
