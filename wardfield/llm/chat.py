"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def conversations(turns: DataFrame, id_: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)`` with the turns of each conversation in order, as ``array<struct<role, text>>``.

    A null role counts as ``unknown`` and a null text as empty; null turn numbers come first, and turns with one
    number are ordered by role and text. Rows without a conversation id belong to none. Repeated
    rows are repeated turns.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"),
                   F.coalesce(text, F.lit("")).alias("text"))
    lists = turns.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _said(turns: Column) -> Column:
    return F.aggregate(F.filter(turns, lambda t: t["role"] == ASSISTANT), F.lit(0), lambda n, t: n + F.length(t["text"]))


def shared_openings(chats: DataFrame) -> DataFrame:
    """``(kind, chosen_id, rejected_id, chosen, rejected)`` of conversations with the same first turn.

    Of each group the one whose assistant says most (then the smallest id) is chosen over every other one that
    differs from it: a group of n gives n - 1 pairs at most. The best of a group is a partial maximum, and joins back
    by one row per group, so a very common opening can be split.
    """
    rated = chats.select(F.sha2(F.to_json(F.get("turns", F.lit(0))), 256).alias("opening"), "conv_id", "turns", _said(F.col("turns")).alias("said"))
    best = rated.groupBy("opening").agg(F.max(F.struct("said", -F.col("conv_id"))).alias("m"), F.count(F.lit(1)).alias("n"))
    best = best.where("n > 1").select("opening", (-F.col("m.col2")).alias("chosen_id"))
    chosen = best.join(chats, best["chosen_id"] == chats["conv_id"]).select("opening", "chosen_id", F.col("turns").alias("chosen"))
    pairs = rated.join(chosen, "opening").where("conv_id <> chosen_id")
    return pairs.select(F.lit("opening").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))


def stale_replies(chats: DataFrame) -> DataFrame:
    """Each conversation up to its last assistant turn, over the same with a stale last reply.

    The stale reply is the assistant's reply before; the first reply of a conversation is set against an echo of the
    turn before it, or an empty one. Conversations without an assistant turn give no pair.
    """
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), ASSISTANT)
    cut = chats.where(F.exists("turns", lambda t: t["role"] == ASSISTANT)).withColumn("last", at.cast("int"))
    before = F.slice("turns", F.lit(1), F.col("last"))
    cut = cut.select("conv_id", before.alias("before"), F.get("turns", F.col("last")).alias("reply"))
    older = F.filter("before", lambda t: t["role"] == ASSISTANT)
    stale = F.coalesce(F.try_element_at(older, F.lit(-1))["text"], F.try_element_at("before", F.lit(-1))["text"], F.lit(""))
    other = F.struct(F.col("reply.role").alias("role"), stale.alias("text"))
    return cut.select(F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                      F.concat("before", F.array("reply")).alias("chosen"), F.concat("before", F.array(other)).alias("rejected"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(t["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """Turns as one text: a line with the role, the text, an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Run lengths in code points over the rendered turns: ``+n`` is learned from (what the assistant says and its
    end mark), ``-n`` is not."""
    def runs(t):
        sign = F.when(t["role"] == ASSISTANT, F.lit("+")).otherwise(F.lit("-"))
        return F.concat(F.lit("-"), F.length(_head(t)), F.lit(" "), sign, F.length(_body(t)))
    return F.array_join(F.transform(turns, runs), " ")


def preferences(pairs: DataFrame) -> DataFrame:
    """``(kind, chosen_id, rejected_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask)``.

    The longest common prefix of turns is rendered once as the prompt; what follows it in either conversation is a
    completion with its mask. Equal conversations state no preference and give no row; if one is a prefix of the
    other, its completion is empty.
    """
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.filter(F.transform(F.arrays_zip("chosen", "rejected"), lambda z, i: F.when(~z["chosen"].eqNullSafe(z["rejected"]), i)),
                      lambda i: i.isNotNull())
    cut = pairs.withColumn("prompt_turns", F.coalesce(F.array_min(differ), shorter))
    cut = cut.where((F.col("prompt_turns") < F.size("chosen")) | (F.col("prompt_turns") < F.size("rejected")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    return cut.select("kind", "chosen_id", "rejected_id", "prompt_turns", render(F.slice("chosen", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
                      render(rest("chosen")).alias("chosen"), mask(rest("chosen")).alias("chosen_mask"),
                      render(rest("rejected")).alias("rejected"), mask(rest("rejected")).alias("rejected_mask"))


def format_all(turns: DataFrame) -> DataFrame:
    """Preference rows of a table of turns: shared openings and stale replies."""
    chats = conversations(turns)
    return preferences(shared_openings(chats).unionByName(stale_replies(chats)))
