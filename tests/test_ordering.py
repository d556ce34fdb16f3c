"""Order helpers against plain Python, with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from roadflow.operators import ordering

rnd = random.Random(5)
ROWS = [(rnd.choice([1, 1, 1, 2, 3]), rnd.randint(0, 200), n, rnd.randint(1, 9)) for n in range(400)]


def table(spark):
    return spark.createDataFrame(ROWS, "k long, t long, seq long, x long")


def test_neighbours(spark):
    out = ordering.with_neighbours(table(spark), ["k"], ["t", "seq"], F.floor(F.col("t") / 17), ["x", "seq"], "prev", "next")
    got = {r.seq: (r.prev and r.prev.seq, r.next and r.next.seq) for r in out.collect()}
    want = {}
    for k in (1, 2, 3):
        mine = sorted((r for r in ROWS if r[0] == k), key=lambda r: (r[1], r[2]))
        for j, r in enumerate(mine):
            want[r[2]] = (mine[j - 1][2] if j else None, mine[j + 1][2] if j + 1 < len(mine) else None)
    assert got == want


def test_running_total_and_rank(spark):
    out = ordering.running_total(table(spark), ["k"], ["t", "seq"], F.floor(F.col("t") / 23), {"s": F.col("x")})
    got = {r.seq: r.s for r in out.collect()}
    for k in (1, 2, 3):
        total = 0
        for r in sorted((r for r in ROWS if r[0] == k), key=lambda r: (r[1], r[2])):
            total += r[3]
            assert got[r[2]] == total
    ranks = {r.seq: r["rank"] for r in ordering.global_rank(table(spark), ["t", "seq"], F.floor(F.col("t") / 10)).collect()}
    assert [ranks[r[2]] for r in sorted(ROWS, key=lambda r: (r[1], r[2]))] == list(range(1, len(ROWS) + 1))


def test_exclusive_total_starts_at_zero(spark):
    out = ordering.running_total(table(spark), [], ["t", "seq"], F.floor(F.col("t") / 50), {"s": F.lit(1)}, exclusive=True)
    assert sorted(r.s for r in out.collect()) == list(range(len(ROWS)))


def test_fill_and_dense_sequence(spark):
    bounds = spark.createDataFrame([(3, 25)], "a long, b long")
    dense = ordering.dense_sequence(bounds, "a", "b", "f", chunk=4)
    assert sorted(r.f for r in dense.collect()) == list(range(3, 26))
    known = {3: 1.0, 9: 2.0, 20: 5.0}
    gaps = dense.join(spark.createDataFrame(list(known.items()), "f long, v double"), "f", "left")
    got = {r.f: r.v for r in ordering.forward_fill(gaps, "f", F.floor(F.col("f") / 5), ["v"]).collect()}
    last = None
    for f in range(3, 26):
        last = known.get(f, last)
        assert got[f] == last


def test_empty_input(spark):
    none = table(spark).where("false")
    assert ordering.with_neighbours(none, ["k"], ["t"], F.col("t"), ["x"]).count() == 0
    assert ordering.running_total(none, ["k"], ["t"], F.col("t"), {"s": F.col("x")}).count() == 0


def test_neighbours_keep_all_partitions(spark):
    """Shuffle partitions are not joined into a few large ones before the sorts."""
    out = ordering.with_neighbours(table(spark), ["k"], ["t", "seq"], F.floor(F.col("t") / 17), ["x"])
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
