import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from roadflow.llm import weak_labels as L

FOLDER = "/root/testdata/sf0.1"


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _corpus(n, seed=3):
    """Texts of plain words, a tenth of them with words of two made-up families or an insult; labels with some errors."""
    draw = random.Random(seed)
    docs, labels, truth = [], [], {}
    for k in range(n):
        words = [f"word{draw.randint(0, 400)}x" for _ in range(draw.randint(5, 60))]
        bad = draw.random() < 0.2
        if bad:
            for _ in range(4):
                words[draw.randrange(len(words))] = draw.choice([f"grubl{draw.choice('abcdefg')}", f"snorf{draw.choice('abcdefg')}", "idiot"])
        truth[k] = int(bad)
        docs.append((k, " ".join(words)))
        if draw.random() < 0.7:
            labels.append((k, 1, int(bad) if draw.random() > 0.03 else 1 - int(bad)))
    return docs, labels, truth


def test_signs():
    assert L.signs("idiot") == ["idiot", "idi*", "idio*", "idiot*"]
    assert "~idiot" in L.signs("1d10t") and "~stupid" in L.signs("stuuuupid") and L.signs("ab") == ["ab"]
    assert L.signs("x" * 100) == ["xxx*", "xxxx*", "xxxxx*", "xxxxxx*", "xxxxxxx*", "~x"][:5]


def test_reader_finds_all_signs_of_long_texts(monkeypatch):
    text = "Ébène, stupid—IDIOT!\nx_y " * 30
    want = sorted({s for w in ("ébène", "stupid", "idiot", "x", "y") for s in L.signs(w)})
    assert L.SignReader().read(text) == want
    numbers = {s: k for k, s in enumerate(want)}
    reader = L.SignReader(numbers)
    monkeypatch.setattr(L, "_REMEMBERED", 1)
    assert reader.read(text) == list(range(len(want))) and reader.read(None) == [] and reader.read("") == []


def test_label_model_finds_accuracies_and_correlations():
    draw = np.random.default_rng(5)
    n = 20_000
    hidden = draw.random(n) < 0.3
    rates = [(0.7, 0.05), (0.5, 0.02), (0.6, 0.1)]
    votes = np.stack([np.where(hidden, draw.random(n) < a, draw.random(n) < b) for a, b in rates], 1).astype(float)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)  # the first voter three times
    toxic = np.where(draw.random(n) < 0.1, ~hidden, hidden).astype(float)
    model = L.LabelModel(5)
    for _ in range(15):
        model.update(model.statistics(toxic, votes))
    # Discounted evidence is softer than the true one, so estimates are near the true rates and not equal to them.
    assert abs(model.prior - 0.3) < 0.05
    for k, (a, b) in enumerate(rates):
        assert abs(model.fires[1, k] - a) < 0.06 and abs(model.fires[0, k] - b) < 0.03
    assert np.allclose(model.discount[[0, 3, 4]], 1 / 3, atol=0.05) and (model.discount[1:3] > 0.9).all()
    assert abs(model.label[1] - 0.9) < 0.05
    right = ((model.posterior(toxic, votes) > 0.5) == hidden).mean()
    assert right > (toxic == hidden).mean() + 0.04
    plain = L.LabelModel(5)
    for _ in range(15):
        plain.update(plain.statistics(toxic, votes))
        plain.discount[:] = 1
    assert right > ((plain.posterior(toxic, votes) > 0.5) == hidden).mean() + 0.05


def test_minimise_finds_the_least():
    draw = np.random.default_rng(1)
    x, w = draw.normal(size=(300, 6)), np.array([2.0, -1, 0, 0.5, 3, -2])
    p = L._sigmoid(x @ w)

    def loss(v):
        s = x @ v
        return (np.logaddexp(0, s) - p * s).mean(), x.T @ (L._sigmoid(s) - p) / 300

    assert np.allclose(L.minimise(loss, np.zeros(6), 200), w, atol=1e-2)


def test_learns_families_of_words(spark, documents):
    docs, labels, truth = _corpus(1500)
    table = documents(docs)
    model = L.learn(table, _labels(spark, labels))
    assert any(v.startswith(("gru", "sno")) for v in model.voters)
    fresh = [(10_000 + k, t) for k, (t, bad) in enumerate([("word1x grublz word2x snorfq grublk", 1), ("word1x word7x word9x", 0)])]
    got = {r["doc_id"]: r for r in L.score(documents(docs + fresh), model).collect()}
    assert got[10_000]["predicted"] == 1 and got[10_001]["predicted"] == 0
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k]["predicted"] == truth[k] for k in held]) > 0.97
    # Labels of the held-out fold teach nothing.
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    again = L.learn(table, _labels(spark, turned))
    assert again.signs == model.signs and np.allclose(again.weights, model.weights, atol=1e-6)


def test_no_usable_labels(spark, documents):
    docs = documents([(1, "you idiot"), (2, "fine words"), (3, None), (4, ""), (None, "scum"), (2, "fine words")])
    for labels in ([], [(1, 1, 1)], [(1, None, None), (None, 1, 1), (99, 1, 0)]):
        model = L.learn(docs, _labels(spark, labels))
        rows = L.score(docs, model).collect()
        assert sorted((r["doc_id"] or 0, r["predicted"]) for r in rows) == [(0, 1), (1, 1), (2, 0), (2, 0), (3, 0), (4, 0)]
        assert all(0 <= r["score"] <= 1 for r in rows)
    assert L.score(documents([]), model).collect() == []
    assert L.learn(documents([]), _labels(spark, [(1, 1, 1), (2, 1, 0)])).signs == list(L.INSULTS)


def test_clashing_columns_and_disagreeing_labels(spark, documents):
    docs, labels, _ = _corpus(400)
    labels += [(k, q, 1 - t) for k, q, t in labels[:20]]
    table = documents(docs)
    for name in ("score", "predicted", "toxic", "key", "signs", "sign", "n"):
        table = table.withColumn(name, F.lit("own"))
    out = L.score(table, L.learn(table, _labels(spark, labels)))
    assert out.columns == [*[c for c in table.columns if c not in ("score", "predicted")], "score", "predicted"]
    assert out.where("toxic = 'own' AND signs = 'own' AND predicted IN (0, 1)").count() == 400


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = L.learn(docs, labels)
    rows = L.score(docs, model, keep_columns=["doc_id"]).where(L.held_out()).join(labels, "doc_id").select("toxic", "predicted").collect()
    hit = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    wrong = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert hit > 0.8 and wrong < 0.01
