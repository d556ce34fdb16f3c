"""Token counts by a linear longest-match automaton over a vocabulary trie."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a file with one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


@dataclass
class PieceAutomaton:
    """Trie of the pieces; node 0 is the root.

    Where a node has no edge for the next byte, greedy matching is sure to have
    emitted ``popped[node]`` pieces by then, and what is left to match is the
    text of node ``failure[node]`` (-1: no pieces cover the text).
    """

    edges: np.ndarray  # sorted node * 256 + byte
    targets: np.ndarray
    failure: np.ndarray
    popped: np.ndarray


def build(vocabulary: Iterable[bytes]) -> PieceAutomaton:
    edge: dict[int, int] = {}
    is_piece = [False]
    parents, byte_of = [0], [0]
    for piece in vocabulary:
        node = 0
        for byte in piece:
            target = edge.get(node << 8 | byte)
            if target is None:
                target = edge[node << 8 | byte] = len(is_piece)
                is_piece.append(False)
                parents.append(node)
                byte_of.append(byte)
            node = target
        is_piece[node] = bool(piece)
    n = len(is_piece)
    depth = [0] * n
    for node in range(1, n):  # a parent has a smaller number
        depth[node] = depth[parents[node]] + 1
    failure, popped = [-1] * n, [0] * n
    for node in sorted(range(1, n), key=depth.__getitem__):
        if is_piece[node]:
            failure[node], popped[node] = 0, 1
            continue
        parent, byte = parents[node], byte_of[node]
        at, pops = failure[parent], popped[parent]
        while at >= 0 and (at << 8 | byte) not in edge:
            pops += popped[at]
            at = failure[at]
        if at >= 0:
            failure[node], popped[node] = edge[at << 8 | byte], pops
    keys = np.array(sorted(edge), np.int64)
    return PieceAutomaton(keys, np.array([edge[k] for k in keys.tolist()], np.int64), np.array(failure), np.array(popped))


class WordCounts(dict):
    """Pieces per word, each word matched once while it is remembered.

    A word is matched with a blank before it, in one pass over its bytes.  A word
    that no pieces cover counts as one.
    """

    def __init__(self, automaton: PieceAutomaton, remembered: int = 1 << 19):
        super().__init__()
        self._edges = dict(zip(automaton.edges.tolist(), automaton.targets.tolist()))
        self._failure, self._popped = automaton.failure.tolist(), automaton.popped.tolist()
        self._remembered = remembered

    def __missing__(self, word: bytes) -> int:
        count = self.match(b" " + word)
        if len(word) <= 64:
            if len(self) >= self._remembered:
                self.clear()
            self[word] = count
        return count

    def match(self, text: bytes) -> int:
        edges, failure, popped = self._edges, self._failure, self._popped
        node = count = 0
        for byte in text:
            target = edges.get(node << 8 | byte)
            while target is None:
                if failure[node] < 0:
                    return 1
                count += popped[node]
                node = failure[node]
                target = edges.get(node << 8 | byte)
            node = target
        while node:
            if failure[node] < 0:
                return 1
            count += popped[node]
            node = failure[node]
        return count


def count_tokens(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """Add ``n_words`` and ``n_tokens``, the number of greedy longest-match pieces, to each document.

    Words are runs of bytes other than blanks and control codes 9 to 13.  The
    vocabulary is read where the query is built; the automaton's size follows
    the vocabulary, not the data.  A null or empty text has 0 of both; repeated
    rows are counted one by one; columns of these names are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_tokens") and (keep_columns is None or c in keep_columns)]
    a = build(read_vocabulary(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((a.edges, a.targets, a.failure, a.popped))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(PieceAutomaton(*shared.value))
        for batch in batches:
            n_words, n_tokens = [], []
            for value in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()):
                words = (value.as_py() or b"").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            kept = batch.select(columns)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], [*columns, "n_words", "n_tokens"])

    wanted = [*columns, *([text] if text not in columns else [])]
    schema = T.StructType([
        *docs.select(*columns).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(*wanted).mapInArrow(run, schema)
