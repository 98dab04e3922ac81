"""Preference formatting of chosen and rejected conversations, with DataFrame operations only.

The longest common prefix of turns is found by comparing equal turn numbers, rendered once as the prompt, and
both remainders are rendered as completions with the spans that a loss may see: the texts of assistant turns and
their closing marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.sources.vcf import numbered

#: How a turn is opened and closed in rendered text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _spans(turns: Column) -> Column:
    """(start, end) in characters of what the loss sees of the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(turn["role"]) + len(OPEN) + len(MIDDLE)
        end = first + F.length(turn["text"]) + len(CLOSE)
        seen = F.array(F.struct(first.alias("start"), (end - 1).alias("end")))  # the closing mark, without its line break
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["spans"], seen)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each pair that has both conversations.

    pair_id, n_common (turns of the longest common prefix), prompt (their rendering), chosen and rejected
    (renderings of the rest), chosen_mask and rejected_mask (spans in characters of each completion that a loss
    may see).  A turn is its role and text; nulls are empty strings.  Turns are ordered by `turn`; ties by role and
    text, nulls first.  Equal conversations give two empty completions.  Rows without a pair id are left
    out, as are pairs with one side only; empty tables give no rows.  A conversation must fit in memory, a pair's
    rows meet in one group, and pairs are spread over the cluster.
    """
    sides = []
    for name, df in (("chosen", chosen), ("rejected", rejected)):
        turns = df.select(F.col(f"`{pair}`").alias("pair_id"), F.lit(name).alias("side"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
        sides.append(turns.where("pair_id IS NOT NULL"))
    rows = sides[0].unionByName(sides[1])

    def gathered(side: str) -> Column:
        kept = F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text")))
        return F.transform(F.array_sort(kept), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(side)

    pairs = rows.groupBy("pair_id").agg(gathered("chosen"), gathered("rejected")).where((F.size("chosen") > 0) & (F.size("rejected") > 0))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), shorter), F.slice("rejected", F.lit(1), shorter), lambda a, b: a == b)
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("n_common", F.when(differs > 0, differs - 1).otherwise(shorter).cast("long"))
    common = F.col("n_common").cast("int")

    def text_of(turns: Column) -> Column:
        return F.array_join(F.transform(turns, _rendered), "")

    def rest(side: str) -> Column:
        return F.slice(side, common + 1, F.greatest(F.lit(0), F.size(side) - common))

    pairs = pairs.select("pair_id", "n_common", F.slice("chosen", F.lit(1), common).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return pairs.select("pair_id", "n_common", text_of(F.col("prompt")).alias("prompt"), text_of(F.col("chosen")).alias("chosen"), text_of(F.col("rejected")).alias("rejected"), _spans(F.col("chosen")).alias("chosen_mask"), _spans(F.col("rejected")).alias("rejected_mask"))


def with_other_answers(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations (pair_id, turn, role, text) from one table, for conversations that have an answer.

    Chosen is a conversation as it is.  Rejected is the same with its last assistant turn replaced by that of the next
    conversation, in the order of ids, that has one; the last of them has no pair.  Of several last turns with one number
    the greatest text counts.  Rows without an id are left out.  The ids are numbered by sorted ranges.
    """
    rows = turns.select(F.col(f"`{conversation}`").alias("pair_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.where("pair_id IS NOT NULL")
    last = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    own = numbered(last, ["pair_id"], "_n")
    other = own.select((F.col("_n") - 1).alias("_n"), F.col("last.text").alias("_other"))
    named = own.join(other, "_n").select("pair_id", "last", "_other")
    met = rows.join(named, "pair_id")
    replaced = (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("text") == F.col("last.text"))
    return met.select("pair_id", "turn", "role", "text"), met.select("pair_id", "turn", "role", F.when(replaced, F.col("_other")).otherwise(F.col("text")).alias("text"))
