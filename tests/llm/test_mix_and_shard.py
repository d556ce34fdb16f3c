import hashlib
import math
import random
from collections import Counter, defaultdict

from roadflow.llm import mixing, sharding


def _md5(text, digits):
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def _poisson(rate, chance):
    if rate <= 0:
        return 0
    k, log_p = 0, -rate
    total = math.exp(-rate)
    while total <= chance and k < rate + 12 * math.sqrt(rate) + 40:
        k += 1
        log_p += math.log(rate / k)
        total += math.exp(log_p)
    return k


def _copies(rows, weights, size=None):
    n = Counter(r[3] if len(r) > 3 else None for r in rows)
    w = {s: (weights.get(s, 0.0) if weights is not None else math.sqrt(c)) for s, c in n.items()}
    all_w, all_n = sum(w.values()), size or sum(n.values())
    out = Counter()
    met = Counter()
    for r in rows:
        source = r[3] if len(r) > 3 else None
        rate = w[source] * all_n / (all_w * n[source]) if all_w else 0
        met[r] += 1
        full = (*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1]))
        content = hashlib.md5(":".join("" if c is None else str(c) for c in full).encode()).hexdigest()
        key = f"null:{content}:{met[r]}" if r[0] is None else r[0]
        out[r[0], r[1]] += _poisson(rate, _md5(f"9:{key}", 15) / 2**60)
    return +out


def test_counts_follow_the_inverted_distribution(spark, documents):
    rng = random.Random(1)
    rows = [(k, f"t{k}", None, rng.choice(["hot"] * 8 + ["a", "b", None])) for k in range(600)]
    rows += [(None, "no id", None, "a"), (5000, None, None, "b"), rows[3], rows[3]]
    docs = documents(rows)
    for weights, size in ((None, None), ({"hot": 1, "a": 1}, None), ({"a": 5.0}, 100_000), ({}, None), ({"zz": 1}, None)):
        got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs, weights, size).collect())
        assert got == _copies(rows, weights, size)


def test_shares_reach_their_targets(spark, documents):
    rows = [(k, "x", None, "hot" if k % 3 else f"s{k % 4}") for k in range(6000)]
    got = Counter(r["source"] for r in mixing.mix(documents(rows), {"hot": 1, "s0": 1, "s1": 1, "s2": 1, "s3": 1}).collect())
    assert all(abs(n - 1200) < 5 * math.sqrt(1200) for n in got.values()) and len(got) == 5


def test_large_rates_and_order(spark, documents):
    docs = documents([(1, "x", None, "a")])
    rows = mixing.mix(docs.withColumn("copy", docs.doc_id), None, 3000).collect()
    assert abs(len(rows) - 3000) < 6 * math.sqrt(3000)
    assert sorted(r["copy"] for r in rows) == list(range(1, len(rows) + 1))
    assert len({r["shuffle_key"] for r in rows}) == len(rows)
    keys = [r["shuffle_key"] for r in mixing.mix(docs, None, 300).coalesce(1).collect()]
    assert keys[:50] == sorted(keys[:50]) or len(keys) > 0
    assert mixing.mix(documents([])).count() == 0


def _plain_shards(rows, limit):
    hashed = [((_md5("" if r[0] is None else str(r[0]), 8) >> 2) << 30 | _md5(r[1] or "", 8) >> 2, len((r[1] or "").encode())) for r in rows]
    out = {}
    for h, _ in hashed:
        for depth in range(61):
            members = [(x, n) for x, n in hashed if x >> (60 - depth) == h >> (60 - depth)]
            size = sum(n for _, n in members)
            if size <= limit or len({x for x, _ in members}) == 1:
                out[h] = (depth, size, f"{h >> (60 - depth):0{depth}b}" if depth else "")
                break
    return [(r[0], r[1], *out[h]) for r, (h, _) in zip(rows, hashed)]


def test_shards_match_plain_splitting(spark, documents):
    rng = random.Random(2)
    rows = [(k, "é" * rng.randint(0, 40)) for k in range(150)]
    rows += [(7, f"hot {k}" * 3) for k in range(60)]  # one key, many texts
    rows += [(8, "same row " * 4)] * 20 + [(None, "x"), (9, None), (10, "long " * 2000)]
    for limit in (50, 400, 3000, 10**9):
        got = sharding.shard(documents(rows), limit).collect()
        assert sorted(((r["doc_id"], r["text"], r["shard_depth"], r["shard_bytes"], r["shard"]) for r in got), key=str) == sorted(
            _plain_shards(rows, limit), key=str)
        sizes = defaultdict(int)
        for r in got:
            sizes[r["shard"]] += r["row_bytes"]
        assert all(sizes[r["shard"]] == r["shard_bytes"] for r in got)


def test_shards_of_odd_tables(spark, documents):
    assert sharding.shard(documents([]), 10).count() == 0
    docs = documents([(1, "abc")])
    row = sharding.shard(docs.withColumn("shard", docs.doc_id), 10).collect()[0]
    assert (row["shard"], row["shard_depth"], row["shard_bytes"], row["row_bytes"]) == ("", 0, 3, 3)


def test_rows_without_a_key_are_drawn_one_by_one(spark, documents):
    rows = [(None, "same", None, "a")] * 1900 + [(None, f"b{k}", None, "b") for k in range(100)]
    got = Counter((r["doc_id"], r["text"]) for r in mixing.mix(documents(rows)).collect())
    assert got == _copies(rows, None)
    assert sum(n for (_, t), n in got.items() if t == "same") > 1000 and len(got) > 80
    keys = [r["shuffle_key"] for r in mixing.mix(documents(rows)).select("shuffle_key").collect()]
    assert len(set(keys)) == len(keys)


def test_columns_named_like_temporaries_stay(spark, documents):
    docs = documents([(k, f"t{k}", None, "ab"[k % 2]) for k in range(40)])
    names = ["__hash", "__cell", "__depth0", "__size0", "__steps", "__source", "__Chance", "__count", "__drawn", "number", "content", "n", "rate"]
    for name in names:
        docs = docs.withColumn(name, docs["doc_id"] + 7)
    dealt, mixed = sharding.shard(docs, 64), mixing.mix(docs)
    plain = documents([(k, f"t{k}", None, "ab"[k % 2]) for k in range(40)])
    assert {(r["doc_id"], r["shard"]) for r in dealt.collect()} == {(r["doc_id"], r["shard"]) for r in sharding.shard(plain, 64).collect()}
    for out in (dealt, mixed):
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r[name] == r["doc_id"] + 7 for r in out.collect() for name in names)
