"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with i (place in the conversation, from 1), n (its number of turns) and the hash (a, b) of the turns up to there.

    The hash of a prefix is that of the prefix one turn shorter, combined by XOR with a hash of the turn at its place (role and text,
    null differing from empty). So a running window over the sorted turns gives all prefixes in one pass, which spills.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.withColumns({"i": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id"))})
    part = [F.col("i"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    placed = placed.withColumns({"a": F.xxhash64(F.lit(1), *part), "b": F.xxhash64(F.lit(2), *part)})
    return placed.withColumns({c: F.bit_xor(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ("a", "b")})


def render(turns: Column) -> Column:
    """ChatML-like text; a marker inside a text is broken by a space."""
    safe = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|im_start|>"), safe(t.role), F.lit("\n"), safe(t.text), F.lit("<|im_end|>\n"))), "")


def maximal_chats(conversations: DataFrame) -> DataFrame:
    """A row for each conversation that no longer one begins with: conv_id, n_turns, n_copies, chat.

    Turns (conv_id, turn, role, text) stand in order of turn, then role, then text (null first); a row logged twice counts once. Of
    conversations with the same turns the smallest conv_id stays and n_copies counts them; turn numbers themselves do not matter.
    Rows of a null conv_id are one conversation; an empty table gives no rows.

    Copies are combined by hash before anything is joined, and the anti-join has one row for each different conversation, so a
    conversation, or a first turn, that a third of all share is no hot key.
    """
    # dealt by conv_id once: repeats, places and prefixes are all found within it
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").dropDuplicates()
    hashed = write_table(_prefixes(turns).drop("turn"), "chat-hashes")
    prefix = ["n", "a", "b"]
    whole = hashed.filter("i = n").groupBy(*prefix).agg(F.min("conv_id").alias("keep"), F.count(F.lit(1)).alias("n_copies"))
    shorter = hashed.filter("i < n").select(F.col("i").cast("long").alias("n"), "a", "b").distinct()
    kept = whole.join(shorter, prefix, "left_anti").select("keep", F.col("n").alias("n_turns"), "n_copies")
    # a null id is an id: joined and grouped by the same two columns, the turns are shuffled once
    named = lambda c: {"id": F.coalesce(c, F.lit(0)), "no_id": F.col(c).isNull()}
    met = hashed.withColumns(named("conv_id")).join(kept.withColumns(named("keep")).drop("keep"), ["id", "no_id"])
    rows = met.groupBy("id", "no_id", "conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("i", "role", "text"))).alias("turns"))
    return rows.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("chat"))


ORACLE = """
WITH c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
g AS (SELECT t, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY t)
SELECT conv_id, CAST(len(t) AS BIGINT) AS n_turns, n_copies,
  array_to_string(list_transform(t, lambda x: '<|im_start|>' || replace(replace(coalesce(x.role, ''), '<|', '< |'), '|>', '| >') || chr(10)
    || replace(replace(coalesce(x.text, ''), '<|', '< |'), '|>', '| >') || '<|im_end|>' || chr(10)), '') AS chat
FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS longer WHERE len(longer.t) > len(g.t) AND longer.t[1:len(g.t)] = g.t)
"""
