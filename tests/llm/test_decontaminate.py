import random

import numpy as np
from brute import passage_hits

from roadflow.llm import decontaminate
from roadflow.llm.suffixes import MAX_PLACES, PhraseIndex, WaveletRanks, suffix_order


def _plain_order(codes):
    # A 0 is a symbol of its own: smaller than every code, and ordered by place.
    key = [(1, c) if c else (0, p) for p, c in enumerate(codes)]
    return sorted(range(len(codes)), key=lambda p: key[p:])


def test_suffix_order_and_ranks():
    rng = random.Random(1)
    for _ in range(60):
        codes = [rng.choice([0, 1, 2, 3]) for _ in range(rng.randint(0, 40))] * rng.randint(1, 4) + [0]
        assert suffix_order(np.array(codes, np.int32)).tolist() == _plain_order(codes)
        symbols = np.array(codes)
        ranks = WaveletRanks(symbols, 2)
        for symbol in range(4):
            at = np.arange(len(codes) + 1)
            assert ranks.rank(np.full(len(at), symbol), at).tolist() == [codes[:k].count(symbol) for k in at]
        found, before = ranks.symbol_and_rank(np.arange(len(codes)))
        assert found.tolist() == codes
        assert before.tolist() == [codes[:k].count(c) for k, c in enumerate(codes)]


def test_phrases_are_counted_and_located():
    rng = random.Random(2)
    codes = np.array([rng.choice([0, 1, 2]) for _ in range(3000)] + [0], np.int32)
    index = PhraseIndex(codes, 2)
    text = codes.tolist()
    for size in (1, 2, 5, 9):
        for _ in range(20):
            phrase = [rng.choice([1, 2]) for _ in range(size)]
            low, high = index.ranges(np.array([[0] * (10 - size) + phrase]), np.array([size]))
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [k for k in range(len(text) - size + 1) if text[k : k + size] == phrase]


WORDS = [f"w{k}" for k in range(30)]


def _check(spark, documents, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_passages(documents(docs), bench, **options)
    rows = found.withColumn("n_hit", decontaminate.hit_count()).collect()
    assert len(rows) == len(docs)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["hits"]["n_words"], r["n_hit"], tuple(r["hits"]["items"])) for r in rows)
    want = []
    for key, text in docs:
        n, hit, names = passage_hits(text, items)
        want.append((key is None, key or 0, n, hit, tuple(sorted(str(x) for x in names if x is not None))))
    assert got == sorted(want)
    return rows


def test_matches_plain_search(spark, documents):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.choice([1, 4, 10, 11, 30])))) for k in range(12)]
    items += [(90, None), (91, ""), (92, "?!"), (None, "w1 w2 w3"), (5, "w9 w9 w9")]
    docs = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for k in range(80)]
    docs += [(100 + k, f"Ünd {t.upper()}, x." if t else t) for k, (_, t) in enumerate(items)]
    docs += [(None, "w1 w2 w3"), (7, None), (8, ""), docs[0], docs[0]]
    _check(spark, documents, docs, items)
    # Small shards cut texts into overlapping pieces; small blocks make several passes.
    _check(spark, documents, docs, items, shard_words=25, block_bytes=60)


def test_long_text_and_empty_tables(spark, documents):
    item = " ".join(f"z{k}" for k in range(12))
    long = " ".join(["filler"] * 300_000) + " " + item + " tail"
    rows = _check(spark, documents, [(1, long), (2, "x")], [(1, item)], shard_words=1 << 16)
    assert [(s["start"], s["end"]) for s in next(r for r in rows if r["doc_id"] == 1)["hits"]["spans"]] == [(300_000, 300_012)]
    _check(spark, documents, [(1, "a b c")], [])
    _check(spark, documents, [], [(1, "a b")])
    assert MAX_PLACES == 1 << 20


def test_passages_are_cut(spark, documents):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = documents([(1, "Say: one, TWO three! End."), (2, "nothing here"), (3, None)])
    out = {r["doc_id"]: r["text"] for r in decontaminate.without_passages(docs.withColumn("hits", docs.doc_id), bench).collect()}
    assert out == {1: "Say: ! End.", 2: "nothing here", 3: None}


def test_query_matches_sql(spark):
    import oracle
    from roadflow.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    for name in SQL:
        problem, _ = oracle.compare(spark, oracle.connect(folder), folder, name, QUERIES[name], SQL[name])
        assert problem is None, name
