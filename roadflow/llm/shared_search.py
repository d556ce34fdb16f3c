"""Ranked lexical search of many items at once: sums that items share are added up once for each document."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.session import cut_lineage, discard

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Upper case to lower case, all other ASCII bytes but digits and letters to blanks; other bytes stay.
_TERM_BYTES = bytes(b if b >= 128 or bytes([b]).lower() in _LETTERS and bytes([b]).strip() else 32 for b in range(256)).lower()
_PIECE = 1 << 20


def term_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about a megabyte of text, so that a long text is never a list of all its terms."""
    plain = raw.translate(_TERM_BYTES)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + _PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def terms_of(raw: bytes) -> list[bytes]:
    return [term for piece in term_pieces(raw) for term in piece]


class SharedSums:
    """A graph of sums over the terms of many items in which what several items add up is one node.

    A repeated term of an item is a leaf of its own for each repeat.  Leaves that
    occur in exactly the same items are one shared set.  Items, as lists of such
    sets with the commonest first, are then shortened: neighbours that stand
    together in more than one item become a node, again and again.  Each round
    is linear in what is left of the items.
    """

    def __init__(self, items: list[list[int]]):
        occurring: dict[tuple[int, int], list[int]] = {}
        for number, terms in enumerate(items):
            for term, times in sorted(Counter(terms).items()):
                for repeat in range(times):
                    occurring.setdefault((term, repeat), []).append(number)
        leaves = sorted(occurring)
        self.leaf_terms = np.array([term for term, _ in leaves], np.int64)
        self.children: list[tuple[int, ...]] = []
        self._leaves = len(leaves)
        sets: dict[tuple[int, ...], list[int]] = {}
        for leaf, key in enumerate(leaves):
            sets.setdefault(tuple(occurring[key]), []).append(leaf)
        rows: list[list[int]] = [[] for _ in items]
        for where, members in sorted(sets.items(), key=lambda s: (-len(s[0]), s[0])):
            node = self._node(tuple(members))
            for number in where:
                rows[number].append(node)
        self._pair(rows)
        self.roots = np.array([self._node(tuple(row)) if row else -1 for row in rows], np.int64)
        self.plain_additions = sum(max(0, len(terms) - 1) for terms in items)
        self.additions = sum(len(c) - 1 for c in self.children)
        self._levels()

    def _node(self, members: tuple[int, ...]) -> int:
        if len(members) == 1:
            return members[0]
        self.children.append(members)
        return self._leaves + len(self.children) - 1

    def _pair(self, rows: list[list[int]]) -> None:
        while True:
            seen = Counter(pair for row in rows for pair in zip(row, row[1:]))
            shared = {pair for pair, times in seen.items() if times > 1}
            if not shared:
                return
            made: dict[tuple[int, int], int] = {}
            for row in rows:
                out, k = [], 0
                while k < len(row):
                    here = tuple(row[k : k + 2])
                    # A pair gives way to a commoner one that begins at its second place.
                    if here in shared and seen[here] >= seen.get(tuple(row[k + 1 : k + 3]), 0):
                        if here not in made:
                            made[here] = self._node(here)
                        out.append(made[here])
                        k += 2
                    else:
                        out.append(row[k])
                        k += 1
                row[:] = out

    def _levels(self) -> None:
        depth = [0] * self._leaves
        for members in self.children:
            depth.append(1 + max(depth[m] for m in members))
        self.size = len(depth)
        self.steps = []
        for level in range(1, max(depth, default=0) + 1):
            nodes = [n for n in range(self._leaves, self.size) if depth[n] == level]
            parts = [self.children[n - self._leaves] for n in nodes]
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            self.steps.append((np.array(nodes), np.array([m for p in parts for m in p]), starts))

    def totals(self, values: np.ndarray) -> np.ndarray:
        """``items x documents`` from ``terms x documents``."""
        held = np.empty((self.size, values.shape[1]), values.dtype)
        held[: self._leaves] = values[self.leaf_terms]
        for nodes, members, starts in self.steps:
            held[nodes] = np.add.reduceat(held[members], starts, axis=0)
        out = held[self.roots] if self.size else np.zeros((len(self.roots), values.shape[1]), values.dtype)
        out[self.roots < 0] = 0
        return out


_COUNTED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])


def _count_terms(docs: DataFrame, doc_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """Per document with a term its number of terms, and how often it has which term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps({term: k for k, term in enumerate(vocabulary)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pickle.loads(shared.value)
        for batch in batches:
            keys, ns, terms, tfs = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                n, found = 0, Counter()
                for piece in term_pieces(text.as_py()):
                    n += len(piece)
                    found.update([ids[t] for t in piece if t in ids])
                if n:
                    keys.append(key)
                    ns.append(n)
                    terms.append(list(found))
                    tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])

    texts = docs.where(F.col(text_col).isNotNull())
    return texts.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _COUNTED)


class _Best:
    """The highest scores seen so far, per item."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * items

    def add(self, scores: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        width = scores.shape[1]
        least = np.partition(scores, width - self.k, axis=1)[:, width - self.k] if width > self.k else np.zeros(len(scores), np.int64)
        for item in np.flatnonzero(scores.max(axis=1) > 0).tolist():
            old_scores, old_nameless, old_docs = self.rows[item]
            floor = max(1, int(least[item]), int(old_scores[-1]) if len(old_scores) == self.k else 0)
            at = np.flatnonzero(scores[item] >= floor)
            if len(at):
                s = np.concatenate([old_scores, scores[item, at]])
                m = np.concatenate([old_nameless, nameless[at]])
                d = np.concatenate([old_docs, docs[at]])
                order = np.lexsort((d, m, -s))[: self.k]
                self.rows[item] = s[order], m[order], d[order]


def _weigh(counted: DataFrame, graph: SharedSums, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """``(item, doc_id, score)``: of what each task reads the ``k`` highest scores of each item, for ties those of the smallest ids."""
    shared = counted.sparkSession.sparkContext.broadcast(cloudpickle.dumps((graph, weights)))
    wide = max(1, (1 << 22) // max(1, graph.size, len(weights)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weight = pickle.loads(shared.value)
        best = _Best(len(sums.roots), k)
        for whole in batches:
            for begin in range(0, whole.num_rows, wide):
                batch = whole.slice(begin, wide)
                n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                terms, tfs = batch.column(2), batch.column(3)
                rows = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
                term = terms.flatten().to_numpy(zero_copy_only=False)
                tf = tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 100 - 25 + (25 * n * documents) // length
                values = np.zeros((len(weight), batch.num_rows), np.int64)
                values[term, rows] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))
                ids = batch.column(0)
                best.add(sums.totals(values), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null()))
        for item, (scores, nameless, docs) in enumerate(best.rows):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), item), pa.int32()), pa.array(docs, pa.int64(), mask=nameless), pa.array(scores, pa.int64())],
                    ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, doc_id long, score long")


def _highest(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First within a part of the documents, so that no task gets every task's rows of an item.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    found = found.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order))).where(F.col("place") <= k)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("part", "place")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 1 << 20,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` documents of the highest score above 0, equal scores by ascending id.

    Terms are runs of digits, letters and non-ASCII characters, with A-Z lower-cased.  A term's
    weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document adds for each
    occurrence of a term in the item ``weight * ((10**9 tf) div (1000 tf + 12 m))`` with
    ``m = 75 + (25 n N) div L``: N documents with terms, L all their terms, n those of the
    document.  Counts cover all documents.

    Documents do not move: one pass leaves each document's counts of the items'
    terms, from which N, L and df follow; a second adds up the shared sums
    (``SharedSums``) per document and keeps ``k`` rows an item and task.  Different
    item texts are searched in blocks of about ``block_bytes``, so what the
    driver and the tasks hold of them is bounded; a further block is a further pass.

    A null text has no terms and is never found; an item without terms, or whose
    terms occur nowhere, has no rows.  Repeated documents are ranked one by one,
    a null id after all others; items of equal text get equal lists, one for each row.
    An empty table of documents or items gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    named = items.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).withColumn("key", F.sha2("text", 256))
    texts = named.groupBy("key").agg(F.first("text").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(total) // block_bytes
    results = []
    for number in range(blocks):
        rows = sorted(texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).collect())
        own = [(key, terms_of(text.encode())) for key, text in rows]
        own = [(key, words) for key, words in own if words]
        vocabulary = sorted({w for _, words in own for w in words})
        if not own:
            continue
        ids = {w: k for k, w in enumerate(vocabulary)}
        graph = SharedSums([[ids[w] for w in words] for _, words in own])
        counted = cut_lineage(_count_terms(docs, doc_col, text_col, vocabulary))
        documents, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        dfs = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, df in dfs:
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        if documents:
            keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(own)], "item int, key string")
            found = _highest(_weigh(counted, graph, weights, documents, length, k), ["item"], k)
            results.append(cut_lineage(found.join(keys, "item").select("key", "rank", "doc_id", "score")))
        discard(counted)
    ranked = results[0] if results else spark.createDataFrame([], "key string, rank int, doc_id long, score long")
    for other in results[1:]:
        ranked = ranked.union(other)
    return named.select("item_id", "key").join(ranked, "key").select("item_id", "rank", "doc_id", "score")
