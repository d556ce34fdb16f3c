"""Language identification by prediction by partial matching over bytes, with frozen statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.session import cut_lineage

UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class ContextModel:
    """The context trees of all languages as one automaton.

    A state is the longest context in the tree that ends at a place of the text.
    ``bits[state * symbols + symbol]`` holds the code length of the symbol there
    for each language, ``following`` the next state.
    """

    languages: list[str]
    order: int
    symbol_of: np.ndarray  # byte -> symbol
    symbols: int
    bits: np.ndarray  # (states * symbols, languages) float32
    following: np.ndarray  # (states * symbols,) int32

    @property
    def padding(self) -> int:
        return self.symbols - 1


def train(texts: dict[str, list[bytes]], order: int = 4, cells: int = 6_000_000) -> ContextModel:
    """Count contexts of up to ``order`` bytes and freeze their code lengths.

    ``cells`` bounds states x symbols x languages: the rarest contexts are left
    out of the tree until it fits, always by one common threshold on their count,
    so with a context its shorter beginnings and endings stay.
    """
    languages = sorted(texts)
    if not languages:
        return ContextModel([], order, np.zeros(256, np.int64), 2, np.zeros((2, 0), np.float32), np.zeros(2, np.int32))
    seen = np.zeros(256, bool)
    for parts in texts.values():
        for part in parts:
            seen[np.unique(np.frombuffer(part, np.uint8))] = True
    known = int(seen.sum())
    other, padding, symbols = known, known + 1, known + 2
    symbol_of = np.full(256, other, np.int64)
    symbol_of[seen] = np.arange(known)

    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []  # [language][length - 1] -> packed grams, counts
    for language in languages:
        pieces = []
        for part in texts[language]:
            pieces += [symbol_of[np.frombuffer(part, np.uint8)], np.full(order + 1, padding)]
        stream = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
        lengths = []
        for length in range(1, order + 2):
            n = len(stream) - length + 1
            if n <= 0:
                lengths.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            packed, inside = np.zeros(n, np.int64), np.ones(n, bool)
            for ahead in range(length):
                packed = packed * symbols + stream[ahead : ahead + n]
                inside &= stream[ahead : ahead + n] != padding
            lengths.append(np.unique(packed[inside], return_counts=True))
        grams.append(lengths)

    contexts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for length in range(order):
        packed, where = np.unique(np.concatenate([g[length][0] for g in grams]), return_inverse=True)
        contexts.append(packed)
        counts.append(np.bincount(where, np.concatenate([g[length][1] for g in grams]), len(packed)))
    room = max(1, cells // (symbols * max(1, len(languages))))
    every = np.sort(np.concatenate(counts))[::-1] if counts else np.zeros(0)
    least = 2 if len(every) <= room else max(2, every[room] + 1)
    contexts = [c[n >= least] for c, n in zip(contexts, counts)]
    first = 1 + np.cumsum([0, *(len(c) for c in contexts)])
    states = int(first[-1])

    def state_of(length: int, packed: np.ndarray) -> np.ndarray:
        """State of each packed context, -1 where it isn't in the tree."""
        if length == 0:
            return np.zeros(len(packed), np.int64)
        tree = contexts[length - 1]
        if not len(tree):
            return np.full(len(packed), -1)
        at = np.minimum(np.searchsorted(tree, packed), len(tree) - 1)
        return np.where(tree[at] == packed, first[length - 1] + at, -1)

    shorter = np.full(states, -1, np.int64)
    following = np.zeros((states, symbols), np.int32)
    for length in range(order + 1):
        here = np.zeros(1, np.int64) if length == 0 else contexts[length - 1]
        ids = np.zeros(1, np.int64) if length == 0 else first[length - 1] + np.arange(len(here))
        if length:
            shorter[ids] = state_of(length - 1, here % symbols ** (length - 1))
        back = np.zeros((1, symbols), np.int32) if length == 0 else following[shorter[ids]]
        if length < order:
            longer = state_of(length + 1, (here[:, None] * symbols + np.arange(symbols)).ravel()).reshape(-1, symbols)
            back = np.where(longer >= 0, longer, back)
        following[ids] = back
    following[:, padding] = 0

    bits = np.zeros((states, symbols, len(languages)), np.float32)
    for number in range(len(languages)):
        table = np.zeros((states, symbols), np.float64)
        for length in range(order + 1):
            packed, count = grams[number][length]
            state = state_of(length, packed // symbols)
            table[state[state >= 0], (packed % symbols)[state >= 0]] = count[state >= 0]
        bits[:, :, number] = _code_lengths(table, shorter, order, other, known)
    bits[:, padding, :] = 0
    return ContextModel(languages, order, symbol_of, symbols, bits.reshape(states * symbols, -1), following.ravel())


def _code_lengths(table: np.ndarray, shorter: np.ndarray, order: int, other: int, known: int) -> np.ndarray:
    """Bits per state and symbol: escape with d / (n + d) to the shorter context, excluding what was seen.

    ``d`` is the number of different symbols that followed the context and ``n``
    how often any did.  Below the empty context all 256 byte values that are not
    excluded are equally likely; ``other`` stands for each byte never seen.
    """
    states, symbols = table.shape
    chance = np.zeros((states, symbols))
    reached = np.ones(states)
    excluded = np.zeros((states, symbols), bool)
    at = np.arange(states)
    for _ in range(order + 1):
        live = at >= 0
        count = np.where(excluded, 0, table[np.maximum(at, 0)])
        count[~live] = 0
        n, d = count.sum(1), (count > 0).sum(1)
        new = count > 0
        share = count / np.maximum(n + d, 1)[:, None] * reached[:, None]
        chance[new] = share[new]
        reached = np.where(n > 0, reached * d / np.maximum(n + d, 1), reached)
        excluded |= new
        at = np.where(live, shorter[np.maximum(at, 0)], -1)
    left = 256 - excluded[:, :known].sum(1)
    base = (reached / np.maximum(left, 1))[:, None]
    chance = np.where(excluded, chance, base)
    return -np.log2(np.maximum(chance, 1e-30))


def code_lengths(model: ContextModel, texts: list[bytes], segment: int = 256) -> np.ndarray:
    """Code length in bits of each whole text (rows) in each language (columns).

    Texts are cut into segments that are stepped through side by side.  A
    segment first reads the bytes before it, as many as the longest context, so
    its state, and the sum, are those of one pass over the whole text.
    """
    order, n_languages = model.order, len(model.languages)
    n_segments = np.array([-(-len(t) // segment) for t in texts], np.int64)
    width = np.where(n_segments > 0, order + n_segments * segment, 0)
    begin = np.cumsum(width) - width
    stream = np.full(int(width.sum()), model.padding, np.int64)
    for text, at in zip(texts, begin.tolist()):
        if text:
            stream[at + order : at + order + len(text)] = model.symbol_of[np.frombuffer(text, np.uint8)]
    owner = np.repeat(np.arange(len(texts)), n_segments)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
    at = begin[owner] + number * segment
    state = np.zeros(len(owner), np.int64)
    total = np.zeros((len(owner), n_languages), np.float32)
    for step in range(order + segment):
        cell = state * model.symbols + stream[at + step]
        if step >= order:
            total += model.bits[cell]
        state = model.following[cell].astype(np.int64)
    out = np.zeros((len(texts), n_languages))
    for language in range(n_languages):
        out[:, language] = np.bincount(owner, total[:, language], len(texts))
    return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def held_out(key: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = 1 << 20, folds: int = 5) -> ContextModel:
    """Train on a sample of the labelled documents outside the held-out fold.

    ``sample_bytes`` bounds the sample of each language (in expectation): documents
    are drawn by a hash of their key, with the language's share of bytes as the
    chance, and that of the smallest hash always, so no language is lost.  A text
    longer than the whole sample gives a part of a quarter as many characters,
    placed by the hash.  Of texts sharing a key one is drawn.
    """
    part = max(1, sample_bytes // 4)
    hashed = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    long = F.octet_length(text) > sample_bytes
    start = (1 + F.pmod(hashed, F.greatest(F.lit(1), F.length(text) - part + 1))).cast("int")
    labelled = docs.where(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key, folds)
    ).select(
        F.col(lang).cast("string").alias("lang"), F.when(long, F.substring(text, start, F.lit(part))).otherwise(F.col(text)).alias("text"),
        F.when(long, F.lit(part)).otherwise(F.octet_length(text)).alias("size"), hashed.alias("hash"))
    # Written first, so that its size is known when the join is planned and the texts stay where they are.
    sizes = cut_lineage(labelled.where("size > 0").groupBy("lang").agg(F.sum("size").alias("total"), F.min("hash").alias("least")))
    chance = F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest("total", F.lit(1)))
    drawn = labelled.where("size > 0").join(sizes, "lang").where((F.col("hash") / F.lit(float(1 << 30)) < chance) | (F.col("hash") == F.col("least")))
    rows = drawn.groupBy("lang", "hash").agg(F.min("text").alias("text")).select("lang", "text").collect()
    texts: dict[str, list[bytes]] = {}
    for row in rows:
        if row["text"]:
            texts.setdefault(row["lang"], []).append(row["text"].encode())
    return train(texts)


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: ContextModel, text: str = "text", keep_columns: list[str] | None = None, step_bytes: int = 8 << 20) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to each document, from its whole text alone.

    The language of the shortest code wins, on a tie the first by name; ``score``
    is its posterior share among the learned languages.  A null text, a text
    without a letter, or a model without languages gives ``und`` and 0.  Columns
    of these names in ``docs`` are replaced; ``keep_columns`` names those carried
    along (all by default).
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_columns is None or c in keep_columns)]
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.order, model.symbol_of, model.symbols, model.bits, model.following))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ContextModel(*shared.value)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.schema.get_field_index(text)).cast(pa.binary())]
            names: list[str] = [UNDETERMINED] * len(texts)
            scores = [0.0] * len(texts)
            rows = [k for k, t in enumerate(texts) if t is not None and own.languages and has_letter(t)]
            start = 0
            while start < len(rows):
                end, size = start, 0
                while end < len(rows) and (end == start or size + len(texts[rows[end]]) <= step_bytes):
                    size += len(texts[rows[end]])
                    end += 1
                bits = code_lengths(own, [texts[k] for k in rows[start:end]])
                best = bits.argmin(1)
                gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
                share = 1 / np.exp2(-gap).sum(1)
                for k, b, s in zip(rows[start:end], best.tolist(), share.tolist()):
                    names[k], scores[k] = own.languages[b], s
                start = end
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    wanted = [*columns, *([text] if text not in columns else [])]
    schema = T.StructType([*docs.select(*columns).schema.fields, *PREDICTION.fields])
    return docs.select(*wanted).mapInArrow(run, schema)
