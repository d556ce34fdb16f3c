"""From raw documents to mixed and sharded training data, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm import decontaminate, jaccard, language, mixing, sharding
from roadflow.llm.names import free_names
from roadflow.session import cut_lineage

SHARD_LIMIT = 32 << 20


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter have no language and go; the model learns from ``docs`` itself."""
    named = language.predict(docs, language.learn(docs))
    return named.where(F.col("lang_pred") != language.UNDETERMINED).select(*docs.columns)


def _with_key(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a key that tells all its rows apart and follows ``doc_id``.

    Where no id is null or repeated that is the id itself.  Otherwise the rows
    are sorted by id, nulls last, then in their order in the table, numbered, and
    written, as numbers have to stay the same when a part is computed anew.
    """
    doubtful = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if doubtful.isEmpty():
        return docs.withColumn(key, F.col("doc_id"))
    (place,) = free_names([*docs.columns, key], "place")
    by_id = docs.withColumn(place, F.monotonically_increasing_id()).orderBy(F.asc_nulls_last("doc_id"), place)
    return cut_lineage(by_id.withColumn(key, F.monotonically_increasing_id()).drop(place))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a Jaccard similarity of 0.8 over five-word shingles the one with the smallest id stays.

    Equal texts are linked, so of a repeated row one stays; of rows linked under
    one id the first in the table stays, and a null id comes after all others.
    Rows of one id with texts that aren't alike all stay, and so do rows without
    words, which are linked with nothing.
    """
    (key,) = free_names(docs.columns, "row_key")
    keyed = _with_key(docs, key)
    groups = jaccard.near_duplicates(keyed, key=key, width=5, numerator=80, denominator=100)
    others = cut_lineage(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(key)))
    return keyed.join(others, key, "left_anti").select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of ten words of a benchmark item occurs go."""
    found = decontaminate.find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits.spans") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to shares in proportion to the square root of their sizes; rows are repeated and shuffled."""
    return mixing.mix(docs).select(*docs.columns)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard; the columns ``shard``, ``shard_depth``, ``shard_bytes`` and ``row_bytes`` are added."""
    return sharding.shard(docs, SHARD_LIMIT)


STAGES = [
    ("language identification", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing sources to target weights", mix_sources),
    ("sharding", deal_into_shards),
]

#: The language model and its code lengths cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
