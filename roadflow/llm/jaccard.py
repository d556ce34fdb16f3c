"""Exact near-duplicate join of documents by the Jaccard similarity of their word shingles.

The work is laid out so that whole shingle sets travel only for documents that
can have a match at all:

1. Every task hashes the shingles of the documents it scans and sends them,
   packed, to ranges of the hash space.  A range knows in how many documents a
   shingle occurs and tells each batch which of its shingles are shared.
2. A document keeps its shared shingles.  If they make up too small a part of
   its set it can have no match and is done; in most corpora these are nearly
   all documents.
3. What is left is cut into cells by the rarest shingles: a match has one of the
   few rarest shingles of each side in common, so matches never cross cells.
   Cells are packed into bins; large ones are cut into blocks (``cells``).
4. Each bin is searched by T-occurrence (``overlap.OccurrenceIndex``).  A pair
   that earlier links already connect isn't looked at again, so a group of many
   near copies costs about one comparison a member, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.llm.cells import spanning_links
from roadflow.llm.components import connected_components
from roadflow.llm.overlap import Groups, OccurrenceIndex
from roadflow.session import cut_lineage

#: Fixed by the definition of a word: white space is blank and control codes 9 to 13; A-Z are lower-cased.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
#: A batch numbers its documents in 16 bits beside 48 bits of hash; the last number marks a shingle of many documents.
_MANY = 0xFFFF
_HASH_BITS = 48


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multiplier(place: int) -> np.uint64:
    return np.uint64((int(_ODD[place % 8]) * (2 * (place // 8) + 1)) & 0xFFFFFFFFFFFFFFFF)


def batch_shingles(texts: list[bytes | None], width: int, hashes: dict) -> np.ndarray:
    """Distinct ``hash48 << 16 | number of the text``, sorted; a text of fewer words is one shingle."""
    words, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = text.translate(_WORD_BYTES).split()
            counts[k] = len(found)
            words.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
    if not words:
        return np.zeros(0, np.uint64)
    word = np.concatenate(words)
    begin = np.cumsum(counts) - counts
    n = np.where(counts == 0, 0, np.maximum(1, counts - width + 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    held = np.minimum(counts[owner], width)
    value = held.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    last = len(word) - 1
    for ahead in range(width):
        part = word[np.minimum(at + ahead, last)] * _multiplier(ahead)
        value = value + np.where(ahead < held, part, np.uint64(0))
    packed = (_mixed(value) >> np.uint64(16) << np.uint64(16)) | owner.astype(np.uint64)
    packed.sort()
    fresh = np.ones(len(packed), bool)
    fresh[1:] = packed[1:] != packed[:-1]
    return packed[fresh]


def _batches(source: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes | None]]]:
    """Ids, whether they are given, and texts, gathered until about ``words`` words or 60,000 documents are held."""
    ids: list[int | None] = []
    texts: list[bytes | None] = []
    size = 0

    def out():
        known = np.array([i is not None for i in ids], bool)
        return np.array([0 if i is None else i for i in ids], np.int64), known, texts

    for batch in source:
        raw = batch.column(1).cast(pa.binary())
        for key, text in zip(batch.column(0).to_pylist(), raw):
            ids.append(key)
            texts.append(text.as_py())
            size += len(texts[-1] or b"") + 16
            if size >= 6 * words or len(ids) >= 60_000:
                yield out()
                ids, texts, size = [], [], 0
    if ids:
        yield out()


def _prepared(ids, known, texts, width, hashes):
    """Sizes, the text standing for each text (that of the smallest id with the same set; -1 without an id), and their shingles."""
    packed = batch_shingles(texts, width, hashes)
    number = (packed & np.uint64(0xFFFF)).astype(np.int64)
    size = np.bincount(number, minlength=len(texts))
    by_text = np.argsort(number.astype(np.uint16), kind="stable")
    begin = np.cumsum(size) - size
    strong = _mixed(packed[by_text] >> np.uint64(16))
    sums, others = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    if len(packed):
        sums[size > 0] = np.add.reduceat(strong, begin[size > 0])
        others[size > 0] = np.add.reduceat(_mixed(strong), begin[size > 0])
    first: dict[tuple[int, int, int], int] = {}
    stands = np.arange(len(texts))
    by_id = np.argsort(ids, kind="stable").tolist()
    for k in by_id:
        if not known[k]:
            stands[k] = -1
        elif size[k]:
            stands[k] = first.setdefault((int(size[k]), int(sums[k]), int(others[k])), k)
    mine = stands[number] == number
    return size, stands, packed[mine]


def _many(packed: np.ndarray, limit: int) -> np.ndarray:
    """For each entry whether its shingle occurs in at least ``limit`` documents of the batch."""
    value = packed >> np.uint64(16)
    edge = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(value)))
    return np.repeat(count >= limit, count)


_TO_RANGE = T.StructType([
    T.StructField("range", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("entries", T.BinaryType())])
_TO_BATCH = T.StructType([
    T.StructField("batch", T.LongType()), T.StructField("is_docs", T.BooleanType()),
    T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()), T.StructField("d", T.BinaryType())])
_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("stands", T.LongType()),
    T.StructField("n_shared", T.LongType()), T.StructField("shared", T.BinaryType())])


def _batch_name(ids: np.ndarray, known: np.ndarray, packed: np.ndarray) -> int:
    """A batch is known by its content, so both passes over the documents name it alike."""
    content = xxhash.xxh3_64(ids.tobytes())
    content.update(known.tobytes())
    content.update(packed.tobytes())
    return content.intdigest() >> 1


def shared_shingles(docs: DataFrame, width: int, numerator: int, denominator: int, batch_words: int = 1 << 20, many: int = 256) -> DataFrame:
    """``(doc_id, n_shingles, stands, n_shared, shared)`` per document.

    ``shared`` holds the shingles that other documents have too, rarest first, as
    packed ``count << 48 | hash``; it is null for documents that can have no match
    and for those of which an equal set in the same batch ``stands``.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(total // (6 * batch_words)).bit_length())

    def to_ranges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for ids, known, texts in _batches(source, batch_words):
            _, _, packed = _prepared(ids, known, texts, width, hashes)
            heavy = _many(packed, many)
            # Shingles of many documents of this batch go once, as a sign.
            sent = np.unique(np.concatenate([packed[~heavy], packed[heavy] | np.uint64(_MANY)]))
            bound = np.searchsorted(sent, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            parts = np.split(sent, bound)
            filled = [k for k, p in enumerate(parts) if len(p)]
            name = _batch_name(ids, known, packed)
            yield pa.RecordBatch.from_arrays([
                pa.array(filled, pa.int64()), pa.array([name] * len(filled), pa.int64()),
                pa.array([parts[k].tobytes() for k in filled], pa.binary())], _TO_RANGE.names)

    def count(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(e.as_py(), np.uint64) for e in group.column("entries")]
        entries = np.concatenate(parts)
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(entries >> np.uint64(16), kind="stable")
        entries, row = entries[order], row[order]
        value, number = entries >> np.uint64(16), (entries & np.uint64(0xFFFF)).astype(np.uint16)
        edge = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        times = np.diff(np.append(edge, len(value)))
        signed = np.logical_or.reduceat(number == _MANY, edge)
        times = np.where(signed, _MANY, np.minimum(times, _MANY))
        times = np.repeat(times, np.diff(np.append(edge, len(value))))
        kept = (times >= 2) & (number != _MANY)
        keys = (times[kept].astype(np.uint64) << np.uint64(_HASH_BITS)) | value[kept]
        number, row = number[kept], row[kept]
        by_row = np.argsort(row, kind="stable")
        keys, number, row = keys[by_row], number[by_row], row[by_row]
        bound = np.searchsorted(row, np.arange(len(parts) + 1))
        live = [k for k in range(len(parts)) if bound[k + 1] > bound[k]]
        batch = group.column("batch").to_pylist()
        nothing = pa.array([None] * len(live), pa.binary())
        return pa.Table.from_arrays([
            pa.array([batch[k] for k in live], pa.int64()), pa.array([False] * len(live), pa.bool_()),
            pa.array([keys[bound[k] : bound[k + 1]].tobytes() for k in live], pa.binary()),
            pa.array([number[bound[k] : bound[k + 1]].tobytes() for k in live], pa.binary()), nothing, nothing], _TO_BATCH.names)

    def to_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for ids, known, texts in _batches(source, batch_words):
            size, stands, packed = _prepared(ids, known, texts, width, hashes)
            heavy = packed[_many(packed, many)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_batch_name(ids, known, packed)], pa.int64()), pa.array([True], pa.bool_()),
                *[pa.array([x.tobytes()], pa.binary()) for x in (ids, size.astype(np.int64), stands.astype(np.int64), heavy)]], _TO_BATCH.names)

    def gather(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        docs_rows = [r for r in rows if r["is_docs"]]
        if not docs_rows:
            raise RuntimeError("a batch of documents changed between two reads; read them from a written table")
        ids, size, stands = (np.frombuffer(docs_rows[0][c], np.int64) for c in "abc")
        heavy = np.frombuffer(docs_rows[0]["d"], np.uint64)
        keys = [(np.uint64(_MANY) << np.uint64(_HASH_BITS)) | (heavy >> np.uint64(16))]
        number = [(heavy & np.uint64(0xFFFF)).astype(np.int64)]
        # Batches of the same content have one name; what each was told is the same.
        for a, b in {(r["a"], r["b"]) for r in rows if not r["is_docs"]}:
            keys.append(np.frombuffer(a, np.uint64))
            number.append(np.frombuffer(b, np.uint16).astype(np.int64))
        key, owner = np.concatenate(keys), np.concatenate(number)
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        key, owner = key[order], owner[order]
        n_shared = np.bincount(owner, minlength=len(ids))
        bound = np.cumsum(np.append(0, n_shared))
        can_match = (denominator * n_shared >= numerator * size) & (n_shared > 0) & (stands == np.arange(len(ids)))
        shared = [key[bound[k] : bound[k + 1]].tobytes() if can_match[k] else None for k in range(len(ids))]
        known = stands >= 0
        stand_ids = np.where(known, ids[np.maximum(stands, 0)], 0)
        told = pa.Table.from_arrays([
            pa.array(ids, pa.int64(), mask=~known), pa.array(size, pa.int64()), pa.array(stand_ids, pa.int64(), mask=~known),
            pa.array(n_shared, pa.int64()), pa.array(shared, pa.binary())], _SETS.names)
        return pa.concat_tables([told] * len(docs_rows))

    counted = docs.mapInArrow(to_ranges, _TO_RANGE).groupBy("range").applyInArrow(count, _TO_BATCH)
    sets = counted.unionByName(docs.mapInArrow(to_batches, _TO_BATCH)).groupBy("batch").applyInArrow(gather, _SETS)
    return cut_lineage(sets)


_PREFIX = T.StructType([
    T.StructField("shingle", T.LongType()), T.StructField("step", T.LongType()), T.StructField("doc_id", T.LongType())])


def candidate_cells(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """``(node, component)``: documents that may match each other lie in one component.

    A document's match shares at least ``t`` of its ``n`` shingles, so it has one
    of any ``n - t + 1`` of them, here the rarest; those that nobody shares drop
    out of that count.  Sizes of a match differ by less than one geometric step,
    so a document is tied to the first one of its step and of the step below.
    """
    ratio = np.log(denominator / numerator)

    def prefixes(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            shingles, steps, owners = [], [], []
            for key, n, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_shingles", "shared"))):
                shared = np.frombuffer(packed, np.uint64)
                least = -(-numerator * n // denominator)
                head = shared[: max(0, len(shared) - least + 1)]
                shingles.append((head & np.uint64((1 << _HASH_BITS) - 1)).astype(np.int64))
                steps.append(np.full(len(head), int(np.floor(np.log(n) / ratio))))
                owners.append(np.full(len(head), key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (shingles, steps, owners)], _PREFIX.names)

    postings = sets.where("shared IS NOT NULL").select("doc_id", "n_shingles", "shared").mapInArrow(prefixes, _PREFIX)
    postings = cut_lineage(postings)
    centres = postings.groupBy("shingle", "step").agg(F.min("doc_id").alias("centre"))
    # A centre serves its own step and, as the neighbour below, the next one.
    reach = centres.union(centres.select("shingle", F.col("step") + 1, "centre"))
    ties = postings.join(reach, ["shingle", "step"]).select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).where("a <> b").distinct()
    return connected_components(ties)


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def search_bins(sets: DataFrame, cells: DataFrame, numerator: int, denominator: int, bin_shingles: int = 1 << 20) -> DataFrame:
    """Links ``(a, b)`` that span every group of matching documents."""
    rows = sets.where("shared IS NOT NULL").select("doc_id", "n_shingles", "n_shared", "shared")
    placed = cut_lineage(rows.join(cells.withColumnRenamed("node", "doc_id"), "doc_id"))
    def search(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("doc_id").to_pylist(), np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        size = np.array(group.column("n_shingles").to_pylist(), np.int64)[order]
        block = np.array(group.column("block").to_pylist(), np.int64)[order]
        packed = group.column("shared")
        sets_ = [np.frombuffer(packed[k].as_py(), np.uint64) for k in order.tolist()]
        asks = None if group.column("asks")[0].as_py() is None else np.array(group.column("asks").to_pylist(), bool)[order]
        index = OccurrenceIndex(sets_, size)
        joined = Groups(len(ids))
        # Documents of common shingles first: the middle of a group of near copies connects most of it at once.
        weight = np.array([index.lengths(k).mean() if len(index.lists[k]) else 0 for k in range(len(ids))])
        done = np.zeros(len(ids), bool)
        a, b = [], []
        by_size = np.argsort(size, kind="stable")
        sorted_size = size[by_size]
        for query in np.argsort(-weight, kind="stable").tolist():
            if asks is not None and not asks[query]:
                continue
            done[query] = True
            n = int(size[query])
            low = np.searchsorted(sorted_size, -(-numerator * n // denominator))
            high = np.searchsorted(sorted_size, denominator * n // numerator, side="right")
            near = by_size[low:high]
            roots = joined.roots()
            near = near[~done[near] & (roots[near] != roots[query])]
            if asks is not None:
                near = near[~asks[near] & (block[near] != block[query])]
            if not len(near):
                continue
            allowed = np.zeros(len(ids), bool)
            allowed[near] = True
            # i / (n + m - i) >= p / q  is  i >= p (n + m) / (p + q).
            needed = -(-numerator * (n + size) // (numerator + denominator))
            least = int(needed[near].min())
            for match in index.matches(query, allowed, least, needed).tolist():
                if joined.join(query, match):
                    a.append(int(ids[query]))
                    b.append(int(ids[match]))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], _LINKS.names)

    return spanning_links(placed, "doc_id", "n_shared", bin_shingles, ["doc_id", "n_shingles", "shared"], search, _LINKS)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per document.

    Words are runs of anything but blanks and control codes 9 to 13, with A-Z
    lower-cased; the set of a document are its distinct shingles of ``width``
    words, or the whole sequence where there are fewer.  Documents are linked
    when ``denominator * intersection >= numerator * union``; ``component_id`` is
    the smallest id reachable over links.  Nothing is sampled or capped: all
    links between different sets count, equal sets are linked by definition.

    A null or empty text has no shingles and no links.  A row with a null id is
    returned with its size and a null component.  Repeated rows are returned as
    often; ids are taken to name one text.  Shingles are compared by 48-bit hashes.  ``docs`` has to be
    read from a table (two passes must see the same batches; a difference is
    found and raised).
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets = shared_shingles(own, width, numerator, denominator)
    cells = cut_lineage(candidate_cells(sets, numerator, denominator))
    links = cut_lineage(search_bins(sets, cells, numerator, denominator))
    labels = connected_components(links)
    return (
        sets.join(labels.withColumnRenamed("node", "stands"), "stands", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "stands").alias("component_id"))
    )
