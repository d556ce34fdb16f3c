import random

import numpy as np
from brute import jaccard_groups

from roadflow.llm import jaccard
from roadflow.llm.components import connected_components
from roadflow.llm.overlap import OccurrenceIndex, _merge_skip


def _groups(docs, **options):
    return {r[0]: (r[1], r[2]) for r in jaccard.near_duplicates(docs, **options).collect()}


def _near_copies(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


def test_merge_skip():
    rng = random.Random(4)
    for _ in range(300):
        runs = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        share = rng.randint(1, len(runs))
        records, counts = _merge_skip(runs, share)
        want = {k: c for k in range(30) if (c := sum(k in r for r in runs)) >= share}
        assert dict(zip(records.tolist(), counts.tolist())) == want


def test_occurrences():
    rng = random.Random(5)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(5, 40))), np.uint64) for _ in range(80)]
    index = OccurrenceIndex(sets, np.array([len(s) for s in sets]))
    for query in range(80):
        needed = np.array([rng.randint(3, 20) for _ in sets])
        allowed = np.array([k != query and rng.random() < 0.8 for k in range(80)])
        got = set(index.matches(query, allowed, int(needed[allowed].min()), needed).tolist())
        want = {k for k in range(80) if allowed[k] and len(set(sets[k].tolist()) & set(sets[query].tolist())) >= needed[k]}
        assert got == want


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(40)] + [(100, 150 + k) for k in range(30)] + [(7, 7), (300, 300)]
    rng.shuffle(links)
    table = spark.createDataFrame(links + links[:5] + [(None, 1)], "a long, b long")
    got = {r[0]: r[1] for r in connected_components(table).collect()}
    want = {k: 0 for k in range(41)} | {150 + k: 100 for k in range(30)} | {100: 100, 300: 300}
    assert got == want
    assert connected_components(table.where("a > 1000")).count() == 0


def test_matches_plain_join(spark, documents):
    rng = random.Random(7)
    words = [f"v{k}" for k in range(400)]
    texts = []
    for n, edits in ((25, 3), (12, 6), (4, 1), (2, 2)):
        texts += _near_copies(rng, words, n, edits)
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 50))) for _ in range(60)]
    texts += ["a b", "A  B", "a\tb\n", "a b c", "c", "", None, None, "C", "é ü\xa0x y z", texts[0], texts[0].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = documents(rows)
    assert _groups(docs) == jaccard_groups(rows)
    assert _groups(docs, width=5, numerator=80) == jaccard_groups(rows, 5, 80)


def test_splits_do_not_change_the_outcome(spark, documents, monkeypatch):
    rng = random.Random(8)
    words = [f"v{k}" for k in range(90)]
    texts = _near_copies(rng, words, 60, 4) + _near_copies(rng, words, 20, 5) + ["same words in all of these"] * 30
    rows = list(enumerate(texts))
    docs = documents(rows).repartition(5).cache()
    want = jaccard_groups(rows)
    sets = jaccard.shared_shingles(docs.select("doc_id", "text"), 4, 85, 100, batch_words=200, many=3)
    cells = jaccard.candidate_cells(sets, 85, 100)
    links = jaccard.search_bins(sets, cells, 85, 100, bin_shingles=300)
    labels = {r[0]: r[1] for r in connected_components(links).collect()}
    got = {r["doc_id"]: (r["n_shingles"], labels.get(r["stands"], r["stands"])) for r in sets.collect()}
    assert got == want


def test_odd_rows(spark, documents):
    docs = documents([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, None), (2, "A b c d e")])
    rows = sorted(jaccard.near_duplicates(docs).collect(), key=str)
    assert sorted([(r[0], r[1], r[2]) for r in rows], key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 0, 3), (2, 2, 1)], key=str)
    assert jaccard.near_duplicates(documents([])).count() == 0
    long = " ".join(f"w{k}" for k in range(100_000))
    assert _groups(documents([(1, long), (2, long + " more")])) == {1: (99_997, 1), 2: (99_998, 1)}
