"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation many times, each time with some more turns. A conversation whose
turns are the first turns of a longer one is dropped; of equal ones, that with the smallest id stays.
The hash of a prefix is the running exclusive-or over the turns of a hash of place, role and text (two
lanes of 64 bits), so it needs no conversation in one place: turns are dealt into blocks of ``block``
turns, blocks are summed first, and a block's prefix is the sum of those before it. Kept conversations
are rendered by a template in segments of one block.

Defined cases: turns are ordered by number (null first), then role and text; exactly repeated turns
count once; null role or text counts as empty; rows without a conversation id are dropped; an empty
table gives no rows; other columns are ignored. Control marks inside a text are broken by a space.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskbook.session import materialize

#: The marks of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def positions(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", block: int = 256) -> DataFrame:
    """Distinct turns (conv, block, pos, role, text); ``pos`` counts from 1 within the conversation.

    Turn numbers are cut into blocks; only block sizes go over whole conversations.
    """
    turns = (df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .where("conv is not null").distinct()
             .withColumn("block", F.floor(F.col("turn") / block)))
    upto = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("in_block"))
    sizes = sizes.select("conv", F.col("block").alias("of"), F.coalesce(F.sum("in_block").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = turns.withColumn("rank", F.row_number().over(within))
    placed = numbered.alias("t").join(sizes.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")) & F.col("t.block").eqNullSafe(F.col("s.of")))
    return placed.select("t.conv", "t.block", (F.col("before") + F.col("rank")).alias("pos"), "t.role", "t.text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv, pos, p1, p2): hash of the turns up to each place."""
    lanes = {f"x{s}": F.xxhash64(F.lit(s), "pos", "role", "text") for s in (1, 2)}
    hashed = turns.withColumns(lanes).select("conv", "block", "pos", "x1", "x2")
    upto = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    blocks = blocks.select("conv", F.col("block").alias("of"), *[F.coalesce(F.bit_xor(f"b{s}").over(upto), F.lit(0)).alias(f"b{s}") for s in (1, 2)])
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv", "block", "pos", *[F.bit_xor(f"x{s}").over(within).alias(f"r{s}") for s in (1, 2)])
    joined = run.alias("t").join(blocks.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")) & F.col("t.block").eqNullSafe(F.col("s.of")))
    return joined.select("t.conv", "pos", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"p{s}") for s in (1, 2)])


def collapse(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_same) of the conversations that stay; ``n_same``: conversations with the same turns."""
    prefixes = materialize(prefix_hashes(turns), "chat")
    ends = prefixes.groupBy("conv").agg(F.max(F.struct("pos", "p1", "p2")).alias("e")).select("conv", "e.*")
    whole = ends.groupBy("pos", "p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_same"))
    lengths = ends.select("conv", F.col("pos").alias("n"))
    inner = (prefixes.join(lengths, "conv").where("pos < n").select("pos", "p1", "p2").distinct())
    return (whole.join(inner, ["pos", "p1", "p2"], "left_anti")
            .select("conv", F.col("pos").alias("n_turns"), "n_same"))


def render(turns: DataFrame, kept: DataFrame, segment: int = 256) -> DataFrame:
    """(conv, segment, n_turns, n_same, turns_here, text): kept conversations as template text, in
    segments of at most ``segment`` turns that follow each other."""
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE + "\n"))
    return (turns.join(kept, "conv")
            .withColumn("segment", F.floor((F.col("pos") - 1) / segment))
            .groupBy("conv", "segment", "n_turns", "n_same")
            .agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
            .select("conv", "segment", "n_turns", "n_same", F.size("lines").cast("long").alias("turns_here"),
                    F.concat_ws("", F.col("lines.line")).alias("text")))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", block: int = 256) -> DataFrame:
    """Collapse the snapshots of ``df`` and render what stays (see ``render``)."""
    turns = positions(df, conv_col, turn_col, role_col, text_col, block)
    return render(turns, collapse(turns), block)
