"""Chat formatting with DataFrame expressions only.

Template: each run of adjacent turns with one role becomes one block

    <|im_start|>role<|im_sep|>text<|im_join|>text ...<|im_end|>\\n

A conversation's turns are collected once as structs and sorted; runs of one role are
found and merged with array functions, and the pieces are joined.

``<|im_join|>`` keeps the merged turns apart, so a formatted conversation can be
read back turn by turn. Control strings inside roles and texts are escaped with
character references, ``&`` first, which makes the escape reversible.

Defined results: a null text or role counts as empty; a null conversation id is
one conversation of its own; rows that tie on the turn number are ordered by
role, then text; repeated rows are repeated turns; an empty table gives an empty
result; columns other than the four named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, JOIN, END = "<|im_start|>", "<|im_sep|>", "<|im_join|>", "<|im_end|>\n"
#: What is escaped inside texts and by what, the escape sign first.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))
UNESCAPES = (("&lt;", "<"), ("&#91;", "["), ("&amp;", "&"))


def escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), UNESCAPES, text)


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    loss_spans: array of (start, length) in code points of ``formatted``, one per
    turn of loss_role and in order; they cover escaped texts and no markers.
    """
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        escape(F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("text"),
    )
    rows = turns.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    rows = rows.select("conv_id", "turns", begins.alias("begins"))

    def block(begin: Column, k: Column) -> Column:
        """A run of turns of one role, merged."""
        stop = F.coalesce(F.get("begins", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", begin + 1, stop - begin), lambda t: t["text"])
        return F.struct(F.get("turns", begin)["role"].alias("role"), texts.alias("texts"))

    def block_text(b: Column) -> Column:
        return F.concat(F.lit(START), b["role"], F.lit(SEP), F.array_join(b["texts"], JOIN), F.lit(END))

    def lengths(b: Column) -> Column:
        """What stands before each text of a block and the text itself: pairs."""
        lead = F.length(b["role"]).cast("long") + len(START) + len(SEP)
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, lead + len(END)).otherwise(F.lit(len(JOIN)).cast("long")).alias("lead"), F.length(t).cast("long").alias("own"), (b["role"] == loss_role).alias("loss")))

    rows = rows.select("conv_id", F.transform("begins", block).alias("blocks"))
    rows = rows.select("conv_id", F.array_join(F.transform("blocks", block_text), "").alias("formatted"), F.flatten(F.transform("blocks", lengths)).alias("sizes"))
    stops = running_sums(F.transform("sizes", lambda s: s["lead"] + s["own"]))
    # the end mark of the block before is counted with each block's lead, the first has none
    spans = F.zip_with("sizes", stops, lambda s, stop: F.when(s["loss"], F.struct((stop - s["own"] - len(END)).alias("start"), s["own"].alias("length"))))
    return rows.select("conv_id", "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def running_sums(values: Column, part: int = 256) -> Column:
    """The sums of the first 1, 2, ... values, part by part, so that the work doesn't
    grow with the square of their number."""

    def sums(x: Column, start: Column) -> Column:
        grown = F.aggregate(x, F.array(start), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v)))
        return F.slice(grown, 2, F.size(x))

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / part).cast("int")), lambda k: F.slice(x, k * part + 1, part))

        def joined(cut: Column) -> Column:
            zero = F.lit(0).cast("long")
            before = F.concat(F.array(zero), sums(F.transform(cut, lambda p: F.aggregate(p, zero, lambda a, b: a + b)), zero))
            return F.flatten(F.transform(cut, lambda p, k: sums(p, F.get(before, k))))

        return F.get(F.transform(F.array(parts), joined), F.lit(0))

    return F.get(F.transform(F.array(values), whole), F.lit(0))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    quoted = {x: "\\Q" + x + "\\E" for x in (START, SEP, JOIN, END)}
    blocks = F.filter(F.split(formatted, quoted[END]), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(START) + 1, 2**31 - 1), SEP, 1)
        body = F.substring(block, F.length(role) + len(START + SEP) + 1, F.length(block))
        return F.transform(
            F.split(body, quoted[JOIN], -1),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
