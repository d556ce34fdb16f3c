"""Sharding by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadflow.llm.names import free_names
from roadflow.session import cut_lineage

#: Bits of a row's hash: half from its key, half from its text.
HASH_BITS = 60
_HALF = HASH_BITS // 2


def _md5_bits(value: Column, bits: int) -> Column:
    """The first ``bits`` bits of an md5 as a number."""
    digits = -(-bits // 4)
    number = F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")
    return F.shiftright(number, digits * 4 - bits)


def row_hash(key: str, text: str) -> Column:
    """Key bits first; rows of one key share them and differ in the bits of their text."""
    return F.shiftleft(_md5_bits(F.coalesce(F.col(key).cast("string"), F.lit("")), _HALF), _HALF) + _md5_bits(
        F.coalesce(F.col(text), F.lit("")), _HALF
    )


def row_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def directory(entries: DataFrame, limit_bytes: int, spare_bits: int = 6) -> list[tuple[int, DataFrame]]:
    """Leaf buckets of ``entries(hash, bytes)``.

    Returns pairs of a cell depth and a table ``(cell, depth, shard_bytes)``: a
    row whose first bits make up ``cell`` belongs to the bucket of its first
    ``depth`` bits.  A bucket above the limit is split on its next bit, all
    others stay, so ``depth`` is the smallest number of bits at which the bucket
    fits, or at which all of it has one hash and no bit can split it.  Sums over
    cells ``spare_bits`` deeper than an even split answer that for every depth at
    once; cells that are still too large are looked at again, deeper.
    """
    total = entries.agg(F.sum("bytes")).first()[0] or 0
    fine = min(HASH_BITS, max(1, int(total) // limit_bytes).bit_length() + spare_bits)
    levels: list[tuple[int, DataFrame]] = []
    rest, coarse = entries, 0
    while True:
        cells = rest.groupBy(F.shiftright("hash", HASH_BITS - fine).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        cells = cut_lineage(cells)
        by_depth = cells.withColumn("depth", F.explode(F.sequence(F.lit(coarse), F.lit(fine)))).withColumn(
            "prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
        sums = by_depth.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = sums.where((F.col("shard_bytes") <= limit_bytes) | (F.col("low") == F.col("high")))
        leaf = (
            by_depth.select("cell", "depth", "prefix")
            .join(fits.select("depth", "prefix", "shard_bytes"), ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min("depth").alias("depth"), F.min_by("shard_bytes", "depth").alias("shard_bytes"))
        )
        leaf = cut_lineage(leaf)
        levels.append((fine, leaf))
        if fine == HASH_BITS or leaf.count() == cells.count():
            return levels
        rest = rest.withColumn("cell", F.shiftright("hash", HASH_BITS - fine)).join(leaf.select("cell"), "cell", "left_anti").drop("cell")
        coarse, fine = fine + 1, min(HASH_BITS, fine + spare_bits + 2)


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``shard`` (the bucket's hash bits as text), ``shard_depth``, ``shard_bytes`` and ``row_bytes``.

    Null keys and texts count as empty strings.  Rows of one hot key are split
    by their text; rows equal in key and text cannot be split and stay in one
    bucket, as does a single text above the limit (then ``shard_bytes`` exceeds
    the limit).  An empty table has no shards.  Columns of these names in
    ``docs`` are replaced.
    """
    added = ["shard", "shard_depth", "shard_bytes", "row_bytes"]
    docs = docs.drop(*added)
    entries = cut_lineage(docs.select(row_hash(key, text).alias("hash"), row_bytes(text).alias("bytes")))
    hashed, at = free_names([*docs.columns, *added], "__hash", "__cell")
    out = docs.withColumns({hashed: row_hash(key, text), "row_bytes": row_bytes(text)})
    depth, size = F.lit(None).cast("int"), F.lit(None).cast("long")
    for number, (fine, leaf) in enumerate(directory(entries, limit_bytes)):
        deep, full = free_names(out.columns, f"__depth{number}", f"__size{number}")
        out = out.withColumn(at, F.shiftright(hashed, HASH_BITS - fine)).join(
            leaf.select(F.col("cell").alias(at), F.col("depth").alias(deep), F.col("shard_bytes").alias(full)), at, "left").drop(at)
        depth, size = F.coalesce(depth, F.col(deep)), F.coalesce(size, F.col(full))
    out = out.withColumns({"shard_depth": depth, "shard_bytes": size})
    bits = F.expr(f"lpad(bin(shiftright(`{hashed}`, {HASH_BITS} - shard_depth)), shard_depth, '0')")
    return out.withColumn("shard", F.when(F.col("shard_depth") > 0, bits).otherwise(F.lit(""))).select(*docs.columns, *added)
