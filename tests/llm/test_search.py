import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadflow.llm import shared_search as S

_RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return _RUN.findall(low)


def _brute(docs, items, k):
    words = [(d, _terms(t)) for d, t, *_ in docs if t is not None]
    words = [(d, w) for d, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        rows = []
        for d, w in words:
            tf, m, score = Counter(w), 75 + 25 * len(w) * n // total, 0
            for t in _terms(text or ""):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return out


def _key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def _search(spark, docs, items, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, S.search(docs, table, **options).collect()), key=_key)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=15), max_size=12))
def test_shared_sums_equal_plain_sums(items):
    graph = S.SharedSums(items)
    values = np.arange(13 * 3).reshape(13, 3) ** 2
    want = np.array([values[i].sum(0) if i else np.zeros(3, int) for i in items]).reshape(len(items), 3)
    assert (graph.totals(values) == want).all() and graph.additions <= graph.plain_additions


def test_sharing_saves_additions():
    common = list(range(20))
    graph = S.SharedSums([[*common, 30 + k] for k in range(10)] + [[*common[:10], 50], [*common[:10], 51]])
    assert graph.plain_additions == 10 * 20 + 2 * 10 and graph.additions < 50


@given(st.binary(max_size=60))
def test_terms(raw):
    text = raw.decode("latin-1")
    assert [t.decode() for t in S.terms_of(text.encode())] == _terms(text)


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 7)
    text = " one-two three3 fourfourfour é5 " * 20
    assert [t.decode() for t in S.terms_of(text.encode())] == _terms(text)


DOCS = [
    (1, "The red fox. The dog"), (2, "red red RED fox-fox"), (3, "the the the the"), (4, None), (5, ""), (6, "!!! ..."),
    (7, "blue fox"), (8, "blue fox"), (7, "blue fox"), (None, "blue fox"), (9, "é Éa red"), (10, "nothing here at all"), (11, "red " * 5000 + "end"),
]
ITEMS = [(1, "red fox"), (2, "fox fox the É"), (3, None), (4, ""), (5, "absent"), (1, "red fox"), (None, "blue"), (6, "red fox dog the end")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
@pytest.mark.parametrize("k", [20, 2])
def test_brute_force(spark, documents, k, block_bytes):
    assert _search(spark, documents(DOCS), ITEMS, k=k, block_bytes=block_bytes) == sorted(_brute(DOCS, ITEMS, k), key=_key)


def test_empty_tables(spark, documents):
    assert _search(spark, documents([]), ITEMS) == [] and _search(spark, documents(DOCS), []) == []
    assert _search(spark, documents([(1, None), (2, " ")]), ITEMS) == []


def test_clashing_columns(spark, documents):
    docs = documents(DOCS)
    for name in ("n", "terms", "score", "rank", "key", "item", "part", "item_id"):
        docs = docs.withColumn(name, docs["doc_id"] * 0)
    assert _search(spark, docs, ITEMS) == sorted(_brute(DOCS, ITEMS, 20), key=_key)
