"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation many times, once for every turn it had so far.
Each turn gets the hash of all turns up to it; a conversation whose last hash is
a proper prefix hash of another one is dropped by an anti-join, and of equal
conversations the smallest conv_id stays. What is left is rendered.

The rolling hash is the exclusive-or of two 64-bit hashes of (position, role,
text), which can be summed over parts: long conversations are scanned in chunks
of `chunk` turn numbers, and chunk totals are carried forward, so that no task
holds a whole conversation of any length.

Nulls: rows with a null conv_id or turn are no part of any conversation and are
left out; a null role or text counts as empty, and a conversation of very long
texts is rendered whole. Exactly repeated rows count once; rows of one turn that
differ follow each other in order of role and text, and turn numbers may have
gaps of any size. An empty table gives no rows. Columns other than the four
named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_to, saved

START, END = "<|im_start|>", "<|im_end|>"


def positioned(turns: DataFrame, chunk: int = 256) -> DataFrame:
    """conv_id, chunk, pos (from 0), role, text and the rolling hashes a, b of the turns up to this one."""
    clean = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null and turn is not null").distinct()
    clean = clean.withColumn("chunk", F.floor(F.col("turn") / chunk))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    local = clean.withColumn("i", F.row_number().over(inside) - 1)
    sizes = local.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = local.join(sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), ["conv_id", "chunk"])
    placed = placed.withColumn("pos", F.col("base") + F.col("i"))
    for name, seed in (("ha", 1), ("hb", 2)):
        placed = placed.withColumn(name, F.xxhash64(F.lit(seed), "pos", "role", "text"))
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("conv_id", "chunk").agg(F.bit_xor("ha").alias("ta"), F.bit_xor("hb").alias("tb"))
    carried = totals.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(c) for t, c in (("ta", "ca"), ("tb", "cb"))])
    rolled = placed.withColumns({"ra": F.bit_xor("ha").over(so_far), "rb": F.bit_xor("hb").over(so_far)}).join(carried, ["conv_id", "chunk"])
    return rolled.select("conv_id", "chunk", "pos", "role", "text", F.col("ra").bitwiseXOR(F.col("ca")).alias("a"), F.col("rb").bitwiseXOR(F.col("cb")).alias("b"))


def collapsed(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and kept for every conversation."""
    finals = placed.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "pos").alias("h"), (F.max("pos") + 1).alias("n_turns"))
    finals = saved(finals.select("conv_id", "n_turns", "h.a", "h.b"), "conversations")
    # equal conversations are one row from here on, whatever their number
    classes = finals.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("first_id"), F.count("*").alias("copies"))
    proper = placed.join(finals.select("conv_id", F.col("n_turns").alias("all")), "conv_id").where("pos + 1 < all").select((F.col("pos") + 1).alias("n_turns"), "a", "b").distinct()
    maximal = classes.join(proper.withColumn("prefix", F.lit(True)), ["n_turns", "a", "b"], "left").withColumn("maximal", F.col("prefix").isNull()).drop("prefix")
    known = joined_to(finals, saved(maximal, "classes"), ["n_turns", "a", "b"], "copies", max(1, finals.count()))
    return known.select("conv_id", "n_turns", "copies", (F.col("maximal") & (F.col("conv_id") == F.col("first_id"))).alias("kept"))


def rendered(turns: DataFrame, chunk: int = 256, part_turns: int = 256) -> DataFrame:
    """The maximal conversations as text: conv_id, part, n_turns, text.

    Each turn reads <|im_start|>role, a line feed, its text, <|im_end|> and a line feed. A conversation of more than
    `part_turns` turns comes in parts of so many turns (numbered from 0), whose texts make the whole when put together.
    """
    placed = positioned(turns, chunk)
    kept = collapsed(placed).where("kept").select("conv_id")
    said = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(f"{END}\n"))
    part = F.floor(F.col("pos") / part_turns).cast("int")
    parts = placed.join(kept, "conv_id").groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("said"))
    return parts.select("conv_id", "part", F.size("said").alias("n_turns"), F.array_join(F.col("said.said"), "").alias("text"))
