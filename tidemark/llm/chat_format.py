"""Operator 1: preference formatting of chosen and rejected conversations (DataFrame functions only).

The longest common prefix of whole turns (same role and text) is rendered once as the
prompt; what follows on either side is rendered as that side's completion. A completion's
mask is a run-length code over its characters: pairs of a length and whether these
characters count in training (an assistant turn's text and end mark do, headers and other
roles do not).

Nulls and odd rows: a null role is ``unknown``, a null text empty; turns are in the order
of turn (null first), role, text, so repeated rows stand beside each other and all stay;
rows without a pair or side are left out; a pair with one side only has an empty prompt
and an empty completion for the missing side; identical conversations have empty
completions; extra columns are ignored; an empty table gives no rows. Marks inside a text
are broken up (``<|`` becomes ``< |``) so that they cannot pass for turns, in a role also ``|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column, trained: tuple[str, ...]) -> Column:
    """(length, train) pairs, two for each turn: its header and its text with the end mark."""
    pair = lambda n, on: F.struct(n.cast("long").alias("length"), on.alias("train"))
    return F.flatten(F.transform(turns, lambda t: F.array(pair(F.length(_header(t)), F.lit(False)), pair(F.length(_body(t)), t["role"].isin(*trained)))))


def preference_pairs(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text. A row per pair: pair_id,
    prompt_turns, prompt, chosen, rejected (completions), chosen_mask, rejected_mask."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turn = F.struct("turn", F.replace(clean(F.coalesce("role", F.lit("unknown"))), F.lit("|>"), F.lit("| >")).alias("role"), clean(F.coalesce("text", F.lit(""))).alias("text"))
    side = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, turn))).alias(name)
    both = turns.where("pair_id is not null and side in ('chosen', 'rejected')").groupBy("pair_id").agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    split = F.array_position(same, F.lit(False)).cast("int")
    both = both.withColumn("prompt_turns", F.when(split > 0, split - 1).otherwise(F.size("chosen")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    both = both.select("pair_id", "prompt_turns", F.slice("chosen", F.lit(1), F.col("prompt_turns")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return both.select(
        "pair_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("c"), trained).alias("chosen_mask"),
        _mask(F.col("r"), trained).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame, answers: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns: conv_id, turn, role, text. Rows for preference_pairs, a pair for each conversation: the
    conversation itself, and as the rejected side the same with its last answer (the greatest
    turn, then text; rows equal to it as well) replaced by the last answer of the conversation that
    differs in the last bit of the id; by an empty text if that has none."""
    rows = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    order = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    last = rows.where(F.col("role").isin(*answers)).groupBy("conv_id").agg(F.max(order).alias("own"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("own.text").alias("other"))
    joined = rows.withColumn("this", order).join(last, "conv_id", "left").join(other, "conv_id", "left")
    is_last = F.coalesce(F.col("role").isin(*answers) & (F.col("this") == F.col("own")), F.lit(False))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text")))
    return joined.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


def mask_string(mask: str) -> Column:
    """A mask as text: lengths, with a plus before those that count in training."""
    return F.array_join(F.transform(F.col(mask), lambda m: F.concat(F.when(m["train"], "+").otherwise(""), m["length"].cast("string"))), ",")
