"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's word windows."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.llm.suffixes import MAX_PLACES, PhraseIndex

#: Fixed by the definition of a word: lower-cased ASCII letters, digits and everything beyond ASCII.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_RUN = re.compile(rb"[^ ]+")


class _Codes(dict):
    def __missing__(self, word):
        return 0


def benchmark_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Phrases:
    """Distinct windows of a block of items, right-aligned word codes, and the items each window comes from."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.codes = _Codes()
        self.window = window
        names: dict[str, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        owners: set[tuple[int, int]] = set()
        for name, words in items:
            if not words:
                continue
            coded = [self.codes.setdefault(w, len(self.codes) + 1) for w in words]
            owner = -1 if name is None else names.setdefault(name, len(names))
            for start in range(max(1, len(coded) - window + 1)):
                phrase = tuple(coded[start : start + window])
                owners.add((seen.setdefault(phrase, len(seen)), owner))
        self.names = list(names)
        self.matrix = np.zeros((len(seen), window), np.int64)
        self.lengths = np.zeros(len(seen), np.int64)
        for phrase, row in seen.items():
            self.matrix[row, window - len(phrase) :] = phrase
            self.lengths[row] = len(phrase)
        pairs = np.array(sorted(owners), np.int64).reshape(-1, 2)
        self.owners = pairs[:, 1]
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(seen) + 1))


class _Shard:
    """Texts gathered until the index is full; equal texts are indexed once."""

    def __init__(self, phrases: Phrases, limit: int):
        self.phrases, self.limit = phrases, limit
        self.pieces: list[np.ndarray] = []
        self.piece_text: list[int] = []
        self.piece_from: list[int] = []
        self.known: dict[bytes, int] = {}
        self.n_words: list[int] = []
        self.filled = 0
        self.held_bytes = 0

    @property
    def full(self) -> bool:
        return self.filled >= self.limit or self.held_bytes >= 32 * self.limit

    def add(self, text: bytes) -> int:
        """Number of the text within the shard."""
        self.held_bytes += len(text) + 64
        number = self.known.get(text)
        if number is None:
            number = self.known[text] = len(self.n_words)
            words = benchmark_words(text)
            self.n_words.append(len(words))
            codes = np.fromiter(map(self.phrases.codes.__getitem__, words), np.int32, len(words))
            # A text beyond the limit is cut into pieces that overlap by one word less than a window.
            step = self.limit - self.phrases.window
            for start in range(0, max(1, len(codes)), step):
                piece = codes[start : start + self.limit - 1]
                self.pieces.append(piece)
                self.piece_text.append(number)
                self.piece_from.append(start)
                self.filled += len(piece) + 1
        return number

    def search(self) -> list[tuple[list[tuple[int, int]], list[str], bool]]:
        """Merged hit spans, sorted item names, and whether a nameless item matched, per text."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        names: list[set[int]] = [set() for _ in self.n_words]
        first = 0
        while first < len(self.pieces):
            last, size = first, 0
            while last < len(self.pieces) and (last == first or size + len(self.pieces[last]) + 1 <= MAX_PLACES):
                size += len(self.pieces[last]) + 1
                last += 1
            self._search(first, last, size, spans, names)
            first = last
        return [
            (_merged(s), sorted(self.phrases.names[i] for i in n if i >= 0), -1 in n) for s, n in zip(spans, names)
        ]

    def _search(self, first: int, last: int, size: int, spans, names) -> None:
        codes = np.zeros(size, np.int32)
        starts = np.zeros(last - first, np.int64)
        at = 0
        for k in range(first, last):
            piece = self.pieces[k]
            starts[k - first] = at
            codes[at : at + len(piece)] = piece
            at += len(piece) + 1
        if not codes.any():
            return
        index = PhraseIndex(codes, len(self.phrases.codes))
        low, high = index.ranges(self.phrases.matrix, self.phrases.lengths)
        count = high - low
        hit = np.flatnonzero(count > 0)
        if not len(hit):
            return
        which = np.repeat(hit, count[hit])
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + low[which]
        place = index.locate(rows)
        piece = np.searchsorted(starts, place, side="right") - 1
        text = np.array(self.piece_text[first:last])[piece]
        start = place - starts[piece] + np.array(self.piece_from[first:last])[piece]
        end = start + self.phrases.lengths[which]
        by_place = np.lexsort((start, text))
        for t, s, e in zip(text[by_place].tolist(), start[by_place].tolist(), end[by_place].tolist()):
            mine = spans[t]
            if mine and mine[-1][1] >= s:
                mine[-1] = (mine[-1][0], max(mine[-1][1], e))
            else:
                mine.append((s, e))
        owned = self.phrases.owner_start
        for t, phrase in set(zip(text.tolist(), which.tolist())):
            names[t].update(self.phrases.owners[owned[phrase] : owned[phrase + 1]].tolist())


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` and without what stands between the words of one span."""
    raw = text.encode()
    runs = [m.span() for m in _RUN.finditer(raw.translate(_WORD_BYTES))]
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at : runs[start][0]])
        at = runs[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def _item_blocks(items: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """Yield the items in blocks of about ``block_bytes``; long items come as overlapping slices."""
    words = 4096
    raw = items.where(F.col(text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"),
        F.split(F.trim(F.regexp_replace(
            F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ").alias("words"),
    )
    last = F.greatest(F.lit(0), F.floor((F.size("words") - window) / (words - window + 1)))
    parts = raw.select("item", F.explode(F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda k: F.slice("words", k * (words - window + 1) + 1, words))).alias("words"))
    parts = parts.withColumn("size", F.length(F.concat_ws(" ", "words")))
    total = parts.agg(F.sum("size")).first()[0] or 0
    count = 1 + int(total) // block_bytes
    block = F.pmod(F.xxhash64("item", "words"), F.lit(count))
    for number in range(count):
        rows = parts.where(block == number).select("item", "words").collect()
        yield [(r[0], [w.encode() for w in r[1] if w]) for r in rows]


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("nameless", T.BooleanType()),
])


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shard_words: int = 1 << 19,
    block_bytes: int = 4 << 20,
    keep_columns: list[str] | None = None,
) -> DataFrame:
    """Add to each document where windows of benchmark items occur in it.

    Added columns: ``hits`` with ``n_words``, the merged word ``spans`` (end
    exclusive), the sorted ``items`` whose windows occur, and ``nameless``, set
    when an item without an id matched.  ``keep_columns`` names the columns
    carried along (all by default).

    Documents never move: each task indexes what it scans, about ``shard_words``
    words at a time, and searches all windows of the benchmark in that index.
    The benchmark travels to the tasks in blocks of about ``block_bytes``; a
    larger one makes more passes over the same scan.  A column of the documents
    named ``hits`` is replaced.  A text without words, or a
    null text, has 0 words and no spans; repeated rows are answered one by one;
    an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c != "hits" and (keep_columns is None or c in keep_columns)]
    wanted = [*columns, *([text_col] if text_col not in columns else [])]
    found = docs.select(*wanted, F.lit(None).cast(_RESULT).alias("hits"))
    blocks = [
        spark.sparkContext.broadcast(cloudpickle.dumps(Phrases(block, window)))
        for block in _item_blocks(items, item_col, item_text_col, window, block_bytes)
    ]
    for packed in blocks:
        kept = [*(columns if packed is blocks[-1] else wanted), "hits"]
        found = found.mapInArrow(_searcher(packed, text_col, kept, min(shard_words, MAX_PLACES)), found.select(*kept).schema)
    return found


def _searcher(packed, text_col: str, kept: list[str], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = pickle.loads(packed.value)
        shard = _Shard(phrases, shard_words)
        waiting: list[tuple[pa.RecordBatch, list[int | None]]] = []

        def results():
            answers = shard.search()
            for batch, numbers in waiting:
                earlier = batch.column(batch.schema.get_field_index("hits")).to_pylist()
                hits = []
                for number, old in zip(numbers, earlier):
                    spans, names, nameless = ([], [], False) if number is None else answers[number]
                    n_words = 0 if number is None else shard.n_words[number]
                    if old:
                        spans = _merged([*spans, *((s["start"], s["end"]) for s in old["spans"])])
                        names = sorted({*names, *old["items"]})
                        nameless = nameless or old["nameless"]
                    hits.append({"n_words": n_words, "spans": [{"start": s, "end": e} for s, e in spans], "items": names, "nameless": nameless})
                kind = batch.schema.field("hits").type
                at = batch.schema.get_field_index("hits")
                yield batch.set_column(at, batch.schema.field(at), pa.array(hits, kind)).select(kept)

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            begin = 0
            numbers: list[int | None] = []
            for row, text in enumerate(texts):
                raw = text.as_py()
                if raw is None:
                    shard.held_bytes += 64
                numbers.append(None if raw is None else shard.add(raw))
                if shard.full:
                    waiting.append((batch.slice(begin, row + 1 - begin), numbers))
                    yield from results()
                    shard, waiting, numbers, begin = _Shard(phrases, shard_words), [], [], row + 1
            if numbers:
                waiting.append((batch.slice(begin), numbers))
        if waiting:
            yield from results()

    return run


def without_passages(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with the hit words cut out of their texts; other columns stay."""
    docs = docs.drop("hits")
    found = find_passages(docs, items, text_col, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            spans = batch.column("hits").to_pylist()
            out = [
                t if t is None or not h["spans"] else cut_words(t, [(s["start"], s["end"]) for s in h["spans"]])
                for t, h in zip(texts, spans)
            ]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).drop_columns(["hits"])

    return found.mapInArrow(cut, docs.schema)


def hit_count() -> F.Column:
    """Words inside any occurrence, from ``hits``."""
    return F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
