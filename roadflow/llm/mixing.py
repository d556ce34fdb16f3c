"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.llm.names import free_names
from roadflow.session import cut_lineage

_UNIT = float(1 << 60)


def _hash60(*parts: Column) -> Column:
    """The first 60 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _with_draw_key(docs: DataFrame, key: str, name: str) -> DataFrame:
    """Add what a row is drawn by: its key; without one the digest of all its columns and a number among rows equal in all.

    Rows without a key are counted and repeated from the count, which numbers
    equal ones without putting them into one task.
    """
    keyed = docs.where(F.col(key).isNotNull()).withColumn(name, _text(key))
    number, content = free_names(docs.columns, "number", "content")
    nameless = docs.where(F.col(key).isNull()).groupBy(*docs.columns).agg(F.count(F.lit(1)).alias(number))
    nameless = nameless.withColumn(content, F.md5(F.concat_ws(":", *[_text(c) for c in docs.columns])))
    nameless = nameless.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number))))
    return keyed.unionByName(nameless.select(
        *docs.columns, F.concat_ws(":", F.lit("null"), content, F.col(number).cast("string")).alias(name)))


def poisson_steps(rate: Column) -> Column:
    """Distribution function of a Poisson variable at 0, 1, 2, ... far into the tail, as an array.

    Log-probabilities are summed up step by step, so large rates do not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("steps"))

    def step(state, k):
        log_p = state["log_p"] + F.log(rate / k)
        total = state["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.array_append(state["steps"], total).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["steps"])


def source_rates(docs: DataFrame, source: str, weights: Mapping[str, float] | None, rows: int | None) -> DataFrame:
    """Mean repetitions per source: ``(__source, rate)``; one row per source, counted over all rows."""
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.sqrt("n")
    elif weights:
        weight = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])[F.col("__source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    all_weight = sizes.select(F.sum("weight")).scalar()
    wanted = sizes.select(F.sum("n")).scalar() if rows is None else F.lit(rows)
    rate = F.try_divide(F.col("weight") * wanted, all_weight * F.col("n"))
    return sizes.select("__source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    rows: int | None = None,
    source: str = "source",
    key: str = "doc_id",
    seed: int = 9,
) -> DataFrame:
    """Repeat each row so often that sources reach their target weights, and shuffle all rows.

    ``weights`` gives each source's share (any scale; sources not named get 0,
    and rows of theirs go); without it a source weighs the square root of its
    rows.  ``rows`` is the expected size of the outcome, by default that of the
    input.  A row of a source with mean repetition ``rate`` gets as many copies
    as the inverted Poisson distribution says at the row's hash of seed and key,
    so a rerun or a retried task gives the same copies.  The copies are dealt
    out by a hash of seed, key and copy number and lie in its order within each
    partition, whatever their source.

    Adds ``copy`` (from 1) and ``shuffle_key``, replacing columns of these
    names.  A null source is a source of its own (weight 0 where weights are
    given); rows sharing a key get the same number of copies; an empty table
    stays empty.  The table of rates has one row per source: Spark broadcasts it
    where its size allows and otherwise joins by shuffle with skew splitting.
    """
    docs = docs.drop("copy", "shuffle_key")
    chance, steps, of, count, drawn = free_names([*docs.columns, "copy", "shuffle_key"], "__chance", "__steps", "__source", "__count", "__drawn")
    rates = source_rates(docs, source, weights, rows).withColumnRenamed("__source", of).withColumn(steps, poisson_steps(F.col("rate")))
    # Written first, so that its size is known when the join is planned and the rows need not be dealt by source.
    rates = cut_lineage(rates.select(of, F.when(F.col("rate") > 0, F.col(steps)).alias(steps)))
    counted = (
        _with_draw_key(docs, key, drawn)
        .withColumn(chance, _hash60(F.lit(str(seed)), F.col(drawn)) / F.lit(_UNIT))
        .join(rates, F.col(source).eqNullSafe(F.col(of)))
        .withColumn(count, F.size(F.filter(steps, lambda step: step <= F.col(chance))))
        .where(F.col(count) > 0)
    )
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count)))).withColumn(
        "shuffle_key", _hash60(F.lit(str(seed)), F.col(drawn), F.col("copy").cast("string")))
    return copies.select(*docs.columns, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
