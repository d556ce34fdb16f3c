import random

import corpus_pipeline as pipeline
import pytest
from brute import jaccard_groups, passage_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, documents, tmp_path):
    rng = random.Random(1)
    words = {lang: [f"{head}{tail}" for head in heads for tail in "aeioumnr"] for lang, heads in (("en", ["th", "wh", "sh"]), ("de", ["schü", "zw", "pf"]))}
    rows = []
    for k in range(120):
        lang = rng.choice(["en", "de"])
        rows.append((k, " ".join(rng.choices(words[lang], k=rng.randint(12, 60))), lang, rng.choice(["hot"] * 4 + ["a", "b"])))
    item = "some benchmark passage of exactly twelve words stands here for this test"
    rows += [(200 + k, rows[k][1] + " end", rows[k][2], "a") for k in range(5)] + [(300, rows[7][1], "en", "b")]
    rows += [(400, rows[9][1] + " " + item, "en", "a"), (500, "123 456", "en", "a"), (501, None, "en", None), (502, "", None, "b")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, [(1, item)]


def test_stages_take_effect(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    kept = pipeline.keep_known_languages(spark, docs, path)
    assert kept.columns == COLUMNS
    assert {r["doc_id"] for r in kept.collect()} == set(texts) - {500, 501, 502}
    groups = jaccard_groups([(k, texts[k]) for k in texts if k < 500], 5, 80)
    single = pipeline.keep_one_of_each_group(spark, docs.where("doc_id < 500"), path)
    assert single.columns == COLUMNS
    assert {r["doc_id"] for r in single.collect()} == {k for k, (_, g) in groups.items() if g == k}
    clean = pipeline.drop_benchmark_copies(spark, docs, path)
    assert clean.columns == COLUMNS
    assert {r["doc_id"] for r in clean.collect()} == {k for k in texts if not passage_hits(texts[k], items)[1]}
    mixed = pipeline.mix_sources(spark, docs, path)
    assert mixed.columns == COLUMNS and {r["doc_id"] for r in mixed.collect()} <= set(texts)
    dealt = pipeline.deal_into_shards(spark, docs, path)
    assert dealt.columns == [*COLUMNS, "shard", "shard_depth", "shard_bytes", "row_bytes"] and dealt.count() == len(rows)


def test_run(spark, folder):
    path, rows, items = folder
    out = pipeline.run(spark, path).collect()
    assert 60 < len(out) < 250
    known = {(r[0], r[1]) for r in rows}
    assert all((r["doc_id"], r["text"]) in known for r in out)
    assert not {r["doc_id"] for r in out} & {300, 400, 500, 501, 502}
    assert [len(s) for s in pipeline.STAGES] == [2] * 5


def test_repeated_and_null_ids(spark, documents, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(8)]
    near = texts[0] + " end"
    rows = [(5, texts[0])] * 3 + [(2, near), (7, texts[1]), (7, texts[2]), (3, texts[1]), (None, texts[3]), (None, texts[3]), (None, texts[4]),
            (9, texts[4]), (None, None), (None, None), (8, ""), (8, ""), (6, texts[5])]
    path = str(tmp_path / "docs")
    # Extra columns named like the temporary ones, whatever their case, are carried.
    documents(rows).selectExpr("*", "doc_id * 2 AS Row_Key", "'x' AS place").repartition(4).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = pipeline.keep_one_of_each_group(spark, docs, path)
    assert kept.columns == [*COLUMNS, "Row_Key", "place"]
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert left == sorted([(2, near), (3, texts[1]), (7, texts[2]), (None, texts[3]), (9, texts[4]), (None, None), (None, None), (8, ""), (8, ""),
                           (6, texts[5])], key=repr)
    assert all(r["Row_Key"] is None or r["Row_Key"] == 2 * r["doc_id"] for r in kept.collect())
    assert pipeline.keep_one_of_each_group(spark, docs.where("doc_id < 0"), path).isEmpty()
