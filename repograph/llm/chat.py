"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where
neighbours have one role, and concatenated:

    <|start|>ROLE<|says|>TEXT<|next|>TEXT<|end|>

Texts and roles may hold any string. ``<``, any backslashes and ``|`` in them get
one more backslash, so ``<|`` occurs in marks alone and reading back is exact.
The loss mask is a list of (start, length) in code points of the formatted text: one for each text of the trained role.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and
repeated rows have a fixed order and all stay; a null role or text counts as empty; rows with a null
conv_id are one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

START, SAYS, NEXT, END = "<|start|>", "<|says|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_conversations(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """Of (conv_id, turn, role, text): conv_id, formatted, loss_mask (array of start, length)."""
    own = rows.select("conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag("role").over(order)
    lead = F.when(before.isNull(), F.lit(len(START + SAYS)) + F.length("role")).when(before == F.col("role"), F.lit(len(NEXT))).otherwise(F.lit(len(END + START + SAYS)) + F.length("role"))
    placed = own.withColumn("lead", lead.cast("long"))
    placed = placed.withColumn("start", F.sum(F.col("lead") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text"))
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start"))).alias("turns"))
    n = F.size("turns")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    blocks = turns.withColumn("first", first)

    def block(at: Column, k: Column) -> Column:
        own = F.slice("turns", at + 1, F.coalesce(F.get("first", k + 1), n) - at)
        return F.concat(F.lit(START), F.get("turns", at)["role"], F.lit(SAYS), F.array_join(F.transform(own, lambda t: t["text"]), NEXT), F.lit(END))

    mask = F.transform(F.filter("turns", lambda t: t["role"] == trained), lambda t: F.struct(t["start"].alias("start"), F.length(t["text"]).cast("long").alias("length")))
    return blocks.select("conv_id", F.array_join(F.transform("first", block), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Of (conv_id, formatted, loss_mask): also turns (array of role, text) and loss_text, from the formatted text alone."""

    def turns_of(block: Column) -> Column:
        parts = F.split(block, _quoted(SAYS), 2)
        role = unescape(F.substr(F.get(parts, 0), F.lit(len(START) + 1)))
        return F.transform(F.split(F.get(parts, 1), _quoted(NEXT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split("formatted", _quoted(END))
    turns = F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns_of))
    loss = F.transform("loss_mask", lambda m: unescape(F.col("formatted").substr((m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(loss, "")})
