r"""Chat formatting as a relational plan: collect and sort turn structs, merge neighbours, concatenate.

Template, with one block for each run of turns of one role and a join mark between its turns:

    <|turn|>ROLE<|text|>TEXT<|join|>TEXT<|end|>

Escaping inside roles and texts is reversible: every backslash is doubled, then every "<|" becomes "<\|". No
mark can then occur inside a text, and undoing is one left-to-right pass that drops each escaping backslash.
Spark expressions only: no Python sees a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound, need, running_sums

TURN, TEXT, JOIN, END = "<|turn|>", "<|text|>", "<|join|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _merge(turns: Column) -> Column:
    """Runs of one role: array<struct<role, texts>>, from turns in order."""
    empty = F.lit(None).cast("array<struct<role:string,texts:array<string>>>")
    new = lambda i, t: (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
    # Where runs begin, then each run is the slice up to the next beginning: linear in the turns.
    begins = F.filter(F.transform(turns, lambda t, i: F.when(new(i, t), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(begins, 2, F.greatest(F.size(begins), F.lit(1))), F.array(F.size(turns)))
    runs = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.slice(turns, p["a"] + 1, p["b"] - p["a"]))
    merged = F.transform(runs, lambda r: F.struct(r[0]["role"].alias("role"), F.transform(r, lambda t: t["text"]).alias("texts")))
    return F.when(F.size(turns) == 0, empty).otherwise(merged)


def format_chat(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of every conversation.

    turns: rows of conv_id, turn, role, text. Rows sort by turn, then role, then text (so that ties and
    repeated rows have one order); null turns come first; null roles and texts are empty; a row with a null
    conv_id is a conversation of its own, as nothing says which others it belongs to. loss_mask lists the [start, end) code points of formatted that hold
    assistant texts, one interval a turn. Other columns are ignored; an empty table gives no rows.
    """
    rows = need(turns, conv_id="long", turn="long", role="string", text="string")
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = rows.withColumn("own", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    sorted_turns = alone.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list(t)).alias("turns"))
    safe = sorted_turns.select("conv_id", F.transform("turns", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))).alias("turns"))
    blocks = safe.select("conv_id", _merge(F.col("turns")).alias("blocks"))
    head = lambda b: F.concat(F.lit(TURN), b["role"], F.lit(TEXT))
    flat = blocks.select(
        "conv_id",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.concat(
                    F.array(_piece(head(b), F.lit(False))),
                    F.flatten(F.transform(b["texts"], lambda x, i: F.array(_piece(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")), F.lit(False)), _piece(x, b["role"] == "assistant")))),
                    F.array(_piece(F.lit(END), F.lit(False))),
                ),
            )
        ).alias("pieces"),
    )
    ends = running_sums(F.transform("pieces", lambda p: F.length(p["s"])))
    lost = F.filter(F.arrays_zip(ends.alias("end"), F.col("pieces").alias("p")), lambda x: x["p"]["loss"])
    mask = F.transform(lost, lambda x: F.struct((x["end"] - F.length(x["p"]["s"])).alias("start"), x["end"].alias("end")))
    return flat.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), mask.alias("loss_mask"))


def _piece(s: Column, loss: Column) -> Column:
    return F.struct(s.alias("s"), loss.alias("loss"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """The inverse of format_chat: conv_id, turns array<struct<role, text>>, loss_text, formatted.

    turns come from splitting formatted at its marks, loss_text from cutting formatted at loss_mask.
    """
    cut = lambda c, mark: F.split(c, "\\Q" + mark + "\\E", -1)
    block = lambda b: F.get(cut(b, END), F.lit(0))
    pieces = cut(F.col("formatted"), TURN)
    blocks = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), block)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                cut(F.get(cut(b, TEXT), F.lit(1)), JOIN),
                lambda x: F.struct(unescape(F.get(cut(b, TEXT), F.lit(0))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    return formatted.select("conv_id", turns.alias("turns"), _cut(F.col("formatted"), F.col("loss_mask")).alias("loss_text"), "formatted")


def _cut(text: Column, mask: Column) -> Column:
    """The unescaped text under a mask's intervals, in order, nothing between.

    A position in a text is found by walking there, so intervals are cut out of stretches of the text, each with
    some root of their number, and not all out of the whole.
    """
    piece = lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int"))

    def stretch(m):
        first, last = F.get(m, F.lit(0))["start"], F.element_at(m, -1)["end"]
        return bound(piece(text, first, last - first), lambda t: F.array_join(F.transform(m, lambda x: unescape(piece(t, x["start"] - first, x["end"] - x["start"]))), ""))

    step = F.ceil(F.sqrt(F.size(mask))).cast("int")
    parts = F.transform(F.sequence(F.lit(1), F.size(mask), step), lambda i: bound(F.slice(mask, i, step), stretch))
    return F.when(F.size(mask) == 0, F.lit("")).otherwise(F.array_join(parts, ""))
