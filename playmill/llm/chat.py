r"""Operator 11 [native]: chat formatting by prefix-target expansion.

A conversation's turns stand by their number.  Every assistant turn becomes an example of its own: all turns before it
are the context, its reply is all that the loss mask covers.  Where turns follow the last assistant turn, one more
example holds them with an empty mask, so nothing is lost.

The template writes a turn as ``### role: text</turn>`` and a line feed.  Inside roles and texts a backslash is doubled
and every control string gets one after its first character (``<\/turn>``), so control strings of the output are the
template's own; reading back splits at them and drops one backslash each.

Conversations of more than ``block`` turns are written in blocks of so many first, so no task gathers a conversation's
turns and each is formatted once a block: ``chat_examples`` gives the turns of an example's own block.  ``whole_examples``
then puts all blocks before it in front, so every example holds its whole context; a row holds one example, and what is
put in front is the same text for a block.  Whole output is quadratic in the turns of a conversation by nature.

Cases: a null text or role is empty; a null turn comes before all others; turns of one number stand by role and text,
and repeated rows are turns of their own; rows without a conv_id are one conversation; very long texts are kept whole;
empty texts give a turn with an empty mask; roles other than ``assistant`` (exactly so) are context; extra columns are not
read, whatever their names; an empty table gives no examples.  The digests of ``read_back`` need a conversation's text in
one row, as sha256 runs over it from end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playmill.llm.common import materialize, parts_for, range_rank

OPEN, COLON, CLOSE = "### ", ": ", "</turn>"
ESCAPE = "\\"
REPLY = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without control strings: backslashes doubled, and one after the first character of each control string."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in (OPEN, COLON, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, and the turn as formatted: head, body)."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.select("*", F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(COLON)).alias("head"), escaped(F.col("text")).alias("body"))


def _in_blocks(turns: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, last, turns): each conversation's turns in order, at most ``block`` in a row, and its last block; a single shuffle where none has more."""
    turn = F.struct("turn", "role", "text", "head", "body").alias("t")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    long = materialize(counts.select("conv_id"), "long-conversations")
    gather = lambda df, *keys: df.groupBy(*keys).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = lambda df: gather(df.select("conv_id", turn), "conv_id").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("block", "last")], "turns")
    if long.isEmpty():
        return alone(turns)
    few = long.count() <= 1_000_000
    other = (F.broadcast(long) if few else long).withColumnRenamed("conv_id", "__conv")
    same = turns["conv_id"].eqNullSafe(other["__conv"])
    short = alone(turns.join(other, same, "left_anti"))
    held = materialize(turns.join(other, same, "left_semi").withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))), "long-turns")
    ranked = range_rank(held, "__key", ["turn", "role", "text"], parts_for(held.count()))
    placed = ranked.select("conv_id", F.expr(f"rank div {block}").alias("block"), F.expr(f"(members - 1) div {block}").alias("last"), turn)
    return short.unionByName(gather(placed, "conv_id", "block", "last"))


def chat_examples(rows: DataFrame, block: int = 64) -> DataFrame:
    """(conv_id, block, example, text, loss_start, loss_end, closes, last) of (conv_id, turn, role, text).

    ``example`` is the place of the last turn in its block, from 0; the mask covers the code points from loss_start up to
    loss_end; ``closes`` says that no turn of the block is missing; ``last`` is the conversation's last block.
    """
    blocks = _in_blocks(_turns(rows), block)
    ends = F.filter(F.transform("turns", lambda t, i: F.when((t["role"] == REPLY) | (i == F.size("turns") - 1), i)), lambda i: i.isNotNull())
    each = blocks.select("conv_id", "block", "last", "turns", F.explode(ends).alias("example"))
    last = F.element_at("turns", F.col("example") + 1)
    write = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    start = F.when(last["role"] == REPLY, F.length("text") - F.length(last["body"]) - len(CLOSE) - 1).otherwise(F.length("text"))
    each = each.withColumn("text", write(F.slice("turns", F.lit(1), F.col("example") + 1)))
    return each.select(
        "conv_id",
        "block",
        "example",
        "text",
        start.cast("long").alias("loss_start"),
        F.when(last["role"] == REPLY, F.length("text") - len(CLOSE) - 1).otherwise(F.length("text")).cast("long").alias("loss_end"),
        (F.col("example") == F.size("turns") - 1).alias("closes"),
        "last",
    )


def whole_examples(examples: DataFrame) -> DataFrame:
    """``examples`` with the blocks before each put into its text and its mask moved; its own block begins at ``own_start``.

    Each block is sent to all that follow it, where they are put together once a block; conversations of one block stay
    as they are.
    """
    sent = examples.where("closes and block < last").select("conv_id", F.explode(F.sequence(F.col("block") + 1, F.col("last"))).alias("to"), F.struct("block", "text").alias("part"))
    parts = F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"])
    before = sent.groupBy("conv_id", "to").agg(F.array_join(parts, "").alias("__before")).withColumnRenamed("conv_id", "__conv")
    later = examples.where("block > 0")
    met = later.join(before, later["conv_id"].eqNullSafe(before["__conv"]) & (F.col("block") == F.col("to")))
    moved = F.length("__before").cast("long")
    whole = met.select("conv_id", "block", "example", F.concat("__before", "text").alias("text"), (F.col("loss_start") + moved).alias("loss_start"), (F.col("loss_end") + moved).alias("loss_end"), "closes", "last", moved.alias("own_start"))
    return examples.where("block = 0").withColumn("own_start", F.lit(0).cast("long")).unionByName(whole)


def parsed_turns(text: Column) -> Column:
    """The (role, text) structs of a formatted text."""
    lines = F.filter(F.split(text, CLOSE + "\n"), lambda s: s != "")
    return F.transform(
        lines,
        lambda s: F.struct(
            unescaped(F.substring(s, F.lit(len(OPEN) + 1), F.instr(s, COLON) - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(s, F.instr(s, COLON) + len(COLON), F.length(s))).alias("text"),
        ),
    )


def masked_text(text: str = "text") -> Column:
    """What the loss mask covers, unescaped."""
    return unescaped(F.substring(F.col(text), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what the examples say: its turns, all that the masks cover, and how long their own blocks are.

    The turns of whole examples are those of the longest, the last; else the turns of each block, one after the other.
    """
    whole = "own_start" in examples.columns
    turns = F.when(F.col("closes") & (F.col("block") == F.col("last")) if whole else F.col("closes"), parsed_turns(F.col("text")))
    chars = F.length("text").cast("long") - (F.col("own_start") if whole else 0)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = examples.select("conv_id", F.struct("block", "example", said.alias("said"), masked_text().alias("loss")).alias("part"), F.size(turns).alias("n"), chars.alias("chars"))
    together = parts.groupBy("conv_id").agg(
        F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).cast("long").alias("n_turns"),
        F.sort_array(F.collect_list("part")).alias("parts"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")  # noqa: E731  leaves nulls out
    return together.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.length(p["loss"])).alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
