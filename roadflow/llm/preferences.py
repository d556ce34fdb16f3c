"""Preference data: the shared opening of two conversations as prompt, what follows as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.operators.ordering import global_rank

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, place, role, text)``: turns of each conversation numbered from 1 in the order of turn, role and text.

    The numbering cuts a conversation into blocks of turn numbers, so a very
    long one isn't one task's work.  A null turn comes first; a null role is
    ``unknown``, a null text empty; rows without a conversation go.
    """
    own = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    ranked = global_rank(own, ["turn", "role", "text"], F.floor(F.col("turn") / 1024), "place", ["conv"])
    return ranked.select("conv", "place", "role", "text")


def consecutive_pairs(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """``(chosen_id, rejected_id)``: conversation 2k is preferred to 2k + 1 where both exist."""
    ids = turns.where(F.col(conversation).isNotNull()).select(F.col(conversation).cast("long").alias("chosen_id")).distinct()
    return (
        ids.groupBy(F.floor(F.col("chosen_id") / 2).alias("k"))
        .agg(F.min("chosen_id").alias("chosen_id"), F.max("chosen_id").alias("rejected_id"))
        .where("chosen_id <> rejected_id")
        .select("chosen_id", "rejected_id")
    )


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE), F.lit("\n"))


def pair_turns(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per turn to be written: ``(chosen_id, rejected_id, part, place, role, text, n_prompt)``.

    ``n_prompt`` is the length of the longest common prefix of the two
    conversations in whole turns (same role, same text).  Turns up to it are
    ``prompt`` and come once; later ones are ``chosen`` or ``rejected``.
    """
    pairs = pairs.where("chosen_id IS NOT NULL AND rejected_id IS NOT NULL").select("chosen_id", "rejected_id").distinct()
    sides = pairs.select("chosen_id", "rejected_id", F.explode(F.array(
        F.struct(F.lit("chosen").alias("part"), F.col("chosen_id").alias("conv")),
        F.struct(F.lit("rejected").alias("part"), F.col("rejected_id").alias("conv")))).alias("side"))
    written = sides.select("chosen_id", "rejected_id", "side.part", "side.conv").join(turns, "conv").drop("conv")
    # A place belongs to the prefix if both sides have it with the same content; the first other place ends it.
    # The role's length stands first, so that no line feed in a role or text moves the border between them.
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    places = written.groupBy("chosen_id", "rejected_id", "place").agg(
        F.count(F.lit(1)).alias("n"), F.min(content).alias("low"), F.max(content).alias("high"))
    prefix = places.groupBy("chosen_id", "rejected_id").agg(
        F.coalesce(F.min(F.when((F.col("n") < 2) | (F.col("low") != F.col("high")), F.col("place"))) - 1, F.max("place")).alias("n_prompt"))
    return (
        written.join(prefix, ["chosen_id", "rejected_id"])
        .where((F.col("part") == "chosen") | (F.col("place") > F.col("n_prompt")))
        .withColumn("part", F.when(F.col("place") <= F.col("n_prompt"), F.lit("prompt")).otherwise(F.col("part")))
    )


def preference_examples(turns: DataFrame, pairs: DataFrame, turns_per_row: int = 256, learn_from: str = "assistant") -> DataFrame:
    """The texts of each pair: ``(chosen_id, rejected_id, part, chunk, n_prompt, n_turns, text, loss_spans)``.

    ``part`` is ``prompt``, ``chosen`` or ``rejected``; a part of more than
    ``turns_per_row`` turns continues in further chunks, so no row grows with a
    conversation.  ``loss_spans`` are the character ranges (end exclusive) of the
    row's text that count in training: what the ``learn_from`` role says in a
    completion, with its closing mark.  All else is masked.

    Two equal conversations give a prompt and no completions, two that differ in
    the first turn completions only.  Pairs naming a conversation without turns
    give the other side alone.  Repeated pairs count once; repeated turn rows
    are turns of their own.
    """
    rows = pair_turns(turns, pairs).select(
        "chosen_id", "rejected_id", "part", "n_prompt", "place",
        F.floor((F.col("place") - 1) / turns_per_row).alias("chunk"),
        _rendered(F.col("role"), F.col("text")).alias("out"),
        F.when((F.col("part") != "prompt") & (F.col("role") == learn_from), F.length("text") + len(CLOSE)).otherwise(0).alias("loss"))
    joined = rows.groupBy("chosen_id", "rejected_id", "part", "chunk").agg(
        F.first("n_prompt").alias("n_prompt"), F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("place", "out", "loss"))).alias("turns"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, turn):
        end = state["at"] + F.length(turn["out"])
        # The mark's line break behind the closing mark is not learned.
        span = F.struct((end - 1 - turn["loss"]).cast("int").alias("start"), (end - 1).cast("int").alias("end"))
        return F.struct(end.alias("at"), F.when(turn["loss"] > 0, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return joined.select(
        "chosen_id", "rejected_id", "part", "chunk", "n_prompt", "n_turns",
        F.concat_ws("", F.transform("turns", lambda t: t["out"])).alias("text"),
        F.aggregate("turns", start, step, lambda s: s["spans"]).alias("loss_spans"))
