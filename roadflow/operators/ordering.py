"""Order-dependent building blocks that do not put one key into one task.

A plain ``lag`` or running ``sum`` over ``partitionBy(key)`` sends every row of
a hot key to a single task.  The functions here cut each key into *blocks*
along the order (a monotone function of the order columns, usually a time
bucket), work inside ``(key, block)``, and hand the value that crosses a block
border over in a carry row.  The carry rows come from one small aggregate per
``(key, block)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BLOCK = "__block"
_CARRY = "__carry"


def time_order(time: str = "timestamp", seq: str = "seq") -> Column:
    """Time and append position as one number, for ``max_by`` and ``min_by``.

    A number is updated in place in a hash aggregate, where a struct would make
    every task sort its rows first.  Holds for positions from 0 below 10**18.
    """
    return F.col(time).cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(seq).cast("decimal(19,0)")


def _keyed(keys: Sequence[str]):
    """Window spec over keys, or one spec over the (small) block table when there is no key."""
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Deal rows by ``keys`` over all ``spark.sql.shuffle.partitions``.

    Left to itself Spark joins shuffle partitions until each core has one, or up to 64 MB of
    compressed rows; a task that sorts these several times then takes gigabytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    columns: Sequence[str],
    prev: str | None = "prev",
    following: str | None = None,
) -> DataFrame:
    """Add structs of ``columns`` from the previous and/or next row of the same key, null at the ends."""
    order = list(order)
    rows = df.withColumn(_BLOCK, block).withColumn("__payload", F.struct(*[F.col(c) for c in columns]))
    edge = F.struct(*[F.col(c) for c in order], F.col("__payload"))
    wanted = [(prev, F.max, F.lag), (following, F.min, F.lead)]
    edges = rows.groupBy(*keys, _BLOCK).agg(
        *[pick(edge).alias(f"__{name}") for name, pick, _ in wanted if name]
    )
    both = rows.withColumn(_CARRY, F.lit(False))
    between = _keyed(keys).orderBy(_BLOCK)
    for name, _, step in wanted:
        if name is None:
            continue
        carries = (
            edges.select(*keys, _BLOCK, step(f"__{name}").over(between).alias("__edge"))
            .where("__edge IS NOT NULL")
            .select(*keys, _BLOCK, *[F.col(f"__edge.{c}").alias(c) for c in order if c not in keys],
                    F.col("__edge.__payload").alias("__payload"), F.lit(True).alias(_CARRY))
        )
        both = both.unionByName(carries, allowMissingColumns=True)
    inside = W.partitionBy(*keys, _BLOCK).orderBy(*order)
    return (
        spread(both, *keys, _BLOCK).withColumns({name: step("__payload").over(inside) for name, _, step in wanted if name})
        .where(~F.col(_CARRY))
        .drop(_BLOCK, _CARRY, "__payload")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    totals: Mapping[str, Column],
    exclusive: bool = False,
) -> DataFrame:
    """Add one running sum per entry of ``totals`` over ``order`` within ``keys``."""
    order = list(order)
    names = list(totals)
    rows = df.withColumn(_BLOCK, block)
    for n in names:
        rows = rows.withColumn(f"__in_{n}", totals[n])
    sums = rows.groupBy(*keys, _BLOCK).agg(*[F.sum(f"__in_{n}").alias(f"__in_{n}") for n in names])
    before = _keyed(keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carries = sums.select(
        *keys,
        _BLOCK,
        *[F.sum(f"__in_{n}").over(before).alias(f"__in_{n}") for n in names],
        F.lit(0).alias(_CARRY),
    ).where(" OR ".join(f"__in_{n} IS NOT NULL" for n in names))
    both = rows.withColumn(_CARRY, F.lit(1)).unionByName(carries, allowMissingColumns=True)
    inside = W.partitionBy(*keys, _BLOCK).orderBy(_CARRY, *order)
    upto = inside.rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    out = both
    for n in names:
        out = out.withColumn(n, F.coalesce(F.sum(f"__in_{n}").over(upto), F.lit(0)))
    return out.where(F.col(_CARRY) == 1).drop(_BLOCK, _CARRY, *[f"__in_{n}" for n in names])


def global_rank(df: DataFrame, order: Sequence[str], block: Column, name: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """Add a dense 1-based row number over ``order`` without one task seeing all rows."""
    return running_total(df, keys, order, block, {name: F.lit(1).cast("bigint")})


def forward_fill(df: DataFrame, order: str, block: Column, columns: Sequence[str]) -> DataFrame:
    """Replace nulls in ``columns`` by the last non-null value before them."""
    rows = df.withColumn(_BLOCK, block)
    at = F.col(order)
    lasts = rows.groupBy(_BLOCK).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]
    )
    before = W.partitionBy(F.lit(0)).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carries = lasts.select(
        _BLOCK, *[F.last(c, ignorenulls=True).over(before).alias(c) for c in columns], F.lit(0).alias(_CARRY)
    )
    both = rows.withColumn(_CARRY, F.lit(1)).unionByName(carries, allowMissingColumns=True)
    upto = W.partitionBy(_BLOCK).orderBy(_CARRY, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both
    for c in columns:
        out = out.withColumn(c, F.last(c, ignorenulls=True).over(upto))
    return out.where(F.col(_CARRY) == 1).drop(_BLOCK, _CARRY)


def as_of(asked: DataFrame, facts: DataFrame, keys: Sequence[str], order: str, block: Column, columns: Sequence[str], name: str = "fact") -> DataFrame:
    """Add to each asked row, as a struct ``name``, the ``columns`` of the last fact of its keys not after it in ``order``.

    Facts of equal order are settled by the largest ``columns``.  A row before the
    first fact gets null.  Both tables are cut into ``(keys, block)``; what a block
    begins with comes from one small table of each block's last fact, so no task
    gets a whole key.
    """
    keys = list(keys)
    fact = F.struct(*[F.col(c) for c in columns])
    rows = asked.withColumns({_BLOCK: block, "__fact": F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType), "__kind": F.lit(1)})
    known = facts.withColumns({_BLOCK: block, "__fact": fact}).select(*keys, order, _BLOCK, "__fact", F.lit(0).alias("__kind"))
    lasts = known.groupBy(*keys, _BLOCK).agg(F.max(F.struct(order, "__fact"))["__fact"].alias("__last"))
    blocks = rows.select(*keys, _BLOCK).union(known.select(*keys, _BLOCK)).distinct().join(lasts, [*keys, _BLOCK], "left")
    before = _keyed(keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carries = blocks.select(*keys, _BLOCK, F.last("__last", ignorenulls=True).over(before).alias("__fact"), F.lit(-1).alias("__kind")).where("__fact IS NOT NULL")
    both = rows.unionByName(known, allowMissingColumns=True).unionByName(carries, allowMissingColumns=True)
    upto = W.partitionBy(*keys, _BLOCK).orderBy(F.when(F.col("__kind") < 0, 0).otherwise(1), order, "__kind", "__fact").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn(name, F.last("__fact", ignorenulls=True).over(upto)).where("__kind = 1")
    return found.select(*asked.columns, name)


def dense_sequence(bounds: DataFrame, low: str, high: str, name: str, chunk: int = 4096) -> DataFrame:
    """Rows ``low..high`` (inclusive) of a one-row table, generated in parallel chunks."""
    chunks = bounds.where(F.col(low).isNotNull()).select(
        F.col(low).alias("__low"),
        F.col(high).alias("__high"),
        F.explode(F.sequence(F.floor(F.col(low) / chunk), F.floor(F.col(high) / chunk))).alias("__chunk"),
    )
    spread = chunks.repartition("__chunk")
    first = F.greatest(F.col("__low"), F.col("__chunk") * chunk)
    last = F.least(F.col("__high"), F.col("__chunk") * chunk + (chunk - 1))
    return spread.select(F.explode(F.sequence(first, last)).alias(name))
