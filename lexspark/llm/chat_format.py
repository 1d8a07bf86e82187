"""Chat formatting: collapse cumulative snapshots of conversations, then render what is left.

A logger that stores a conversation after every turn leaves each conversation many times, each a prefix of the next.
Every turn gets a rolling hash of the turns up to it; a conversation whose last hash occurs inside a longer one is a
prefix of that one and goes (an anti-join on (length, hash)); of conversations that are equal the smallest conv_id
stays.  Hashes are 128 bits: two lanes of sums over position-tagged turn hashes, which window frames sum as they go.

Prefixes and whole conversations are aggregated before they are shuffled for the anti-join, so copies of one
conversation, however many, meet as one row per task.  A conversation's own turns meet in one task, as they become one
output row.

Defined results: turns are ordered by (turn, role, text), nulls first; a turn repeated whole counts once; null role
renders as ``unknown`` and null text as empty, and each differs from an empty string when conversations are compared;
rows with null conv_id are no conversation and go; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.columns import pick

#: How a turn is rendered: prefix, role, separator, text, suffix.
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def _lane(seed: int) -> Column:
    parts = [F.lit(seed), F.col("k")]
    for c in ("role", "text"):
        parts += [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]
    return F.xxhash64(*parts).cast("decimal(20,0)")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, n, h1, h2, role, text): the k-th of n turns, with the hash of the first k."""
    # Texts are shuffled here and nowhere else: repeated turns, windows and the final join keep to this partitioning.
    rows = pick(turns, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL").repartition("conv_id").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("k", F.row_number().over(order))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed.withColumn("l1", _lane(11)).withColumn("l2", _lane(29))
    return hashed.select("conv_id", "k", F.count("*").over(Window.partitionBy("conv_id")).alias("n"), F.sum("l1").over(upto).alias("h1"), F.sum("l2").over(upto).alias("h2"), "role", "text")


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the conversations that are no proper prefix of another; equal ones count as one."""
    ends = hashed.filter("k = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashed.filter("k < n").select(F.col("k").cast("bigint").alias("n"), "h1", "h2").distinct()  # as n is, or the join shuffles again
    return ends.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat) for every maximal conversation."""
    hashed = prefix_hashes(turns)
    begin, middle, end = TEMPLATE
    piece = F.concat(F.lit(begin), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end))
    kept = hashed.join(maximal(hashed), "conv_id").select("conv_id", "n_copies", F.struct("k", piece.alias("piece")).alias("turn"))
    whole = kept.groupBy("conv_id").agg(F.max("n_copies").alias("n_copies"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("turns.piece"), "").alias("chat"))
