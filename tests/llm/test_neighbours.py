import math

import numpy as np
from pyspark.sql import functions as F

from roadflow.llm import neighbours
from roadflow.llm.hilbert import hilbert_keys


def test_hilbert_curve_is_continuous():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        along = grid[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def _plain(rows, every, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def _found(table, every, **options):
    out = {}
    for r in neighbours.nearest(table, F.col("vec_id") % every == 0, **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_small_table_is_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(9)]  # ties
    rows += [(200, None), (205, [0.0] * 6), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (215, [float("nan")] * 6), (220, [float("inf")] + [1.0] * 5), (None, rows[0][1])]
    rows += [(225, [1.0, 2.0]), (230, [1.0, 2.0])]  # of another length
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got, want = _found(table, 5), _plain(rows, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [x[0] for x in got[q]] == list(range(1, len(best) + 1))
        assert np.allclose([x[2] for x in got[q]], [s for _, s in best], atol=1e-12)
        if q != 100 and q != 105:
            assert {round(x[2], 9) for x in got[q]} == {round(s, 9) for _, s in best}
    assert [x[1] for x in got[100]] == [3, 101, 102, 103, 104]


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r[0], r[1]) for r in _found(table, 1)[0]] == [(1, 1)]
    assert _found(table.where("vec_id = 0"), 1) == {}
    assert _found(table.where("vec_id > 5"), 1) == {}


def test_pieces_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 32))
    rows = [(k, [float(x) for x in centres[k % 6] + rng.normal(size=32) * 0.8]) for k in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).cache()
    got, want = _found(table, 20, piece_rows=32), _plain(rows, 20)
    hits = sum(len({x[1] for x in got[q]} & {j for j, _ in best}) for q, best in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_query_recall(spark):
    from roadflow.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in QUERIES["op7_neighbours"](spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _plain(rows, 50)
    assert sum(len(got[q] & {j for j, _ in best}) for q, best in want.items()) >= 0.9 * 5 * len(want)


def test_copies_score_by_the_measure_and_ties_go_to_the_smaller_id(spark):
    table = spark.createDataFrame([(0, [0.1, 0.7, 0.3]), (1, [0.2, 1.4, 0.6]), (2, [0.1, 0.7, 0.3]), (3, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    (found,) = _found(table, 50).values()
    assert [v for _, v, _ in found] == [1, 2, 3] and found[0][2] == found[1][2]
    a = np.array([0.1, 0.7, 0.3])
    assert abs(found[0][2] - a @ a / np.linalg.norm(a) ** 2) < 1e-15


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(8)
    rows = [(10 * k, [float(x) for x in rng.normal(size=2 if k < 6 else 3)]) for k in range(11)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = _found(table, 50), _plain(rows, 50)
    assert found.keys() == want.keys() == {0, 50, 100}
    assert all([v for _, v, _ in found[q]] == [v for v, _ in want[q]] for q in want)
