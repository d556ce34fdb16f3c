import math
import random
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import greedy_pieces

from roadflow.llm import pieces, scoring


def test_automaton_matches_greedy():
    rng = random.Random(1)
    for _ in range(40):
        vocabulary = {bytes(rng.choices(b"abc ", k=rng.randint(1, 5))) for _ in range(12)} | ({b" "} if rng.random() < 0.7 else set())
        counts = pieces.WordCounts(pieces.build(vocabulary))
        for _ in range(80):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 12)))
            assert counts[word] == greedy_pieces(b" " + word, vocabulary)


def test_count_tokens(spark, documents):
    vocabulary = set(pieces.read_vocabulary(pieces.DEFAULT_VOCABULARY))
    texts = ["Hello world, größe!", "", None, " \n\t ", "supercalifragilistic " * 300, "日本語 \x00\x01", "x" * 100_000, "a a a"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a"), (7, "a a a")]
    docs = documents(rows)
    out = pieces.count_tokens(docs.withColumn("n_tokens", docs.doc_id)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in out)
    want = []
    for key, text in rows:
        words = (text or "").encode().split()
        want.append((str(key), len(words), sum(greedy_pieces(b" " + w[:40_000], vocabulary) if len(w) < 50_000 else -1 for w in words)))
    long = next(k for k, w in enumerate(want) if w[2] == -1)
    for k, (a, b) in enumerate(zip(got, sorted(want))):
        if sorted(want)[k][2] == -1:
            assert a[:2] == b[:2] and a[2] > 1000
        else:
            assert a == b
    assert long >= 0
    assert pieces.count_tokens(documents([])).count() == 0


def test_probabilities_sum_to_one():
    p = scoring.initial(1)
    around = [1, 2, 0, 4, 5]
    total = 0.0
    for word in range(scoring.WORDS):
        stream = np.array(around[:2] + [word] + around[3:])
        total += float(np.exp(scoring.log_likelihoods(p, stream, np.array([2])))[0])
    assert abs(total - 1) < 1e-3


def test_far_reaching_weights_stay_finite():
    rng = np.random.default_rng(4)
    stream, at = rng.integers(0, scoring.WORDS, 30), np.arange(2, 28)
    for scale in (0.3, 40.0):
        p = {n: (rng.normal(size=v.shape) * scale).astype(np.float32) for n, v in scoring.initial().items()}
        wide = {n: v.astype(np.longdouble) for n, v in p.items()}
        hidden = np.tanh(wide["near_bias"] + sum(wide["near"][k][stream[at + d]] for k, d in enumerate((-2, -1, 1, 2))))
        group, member = np.divmod(stream[at], scoring.GROUPS)
        want = 0
        for x, bias, weights, true in (
            (hidden, wide["group_bias"], wide["group"], group),
            (np.tanh(hidden + wide["shift"][group]), wide["member_bias"][group], wide["member"], member),
        ):
            logits = (x[:, :, None] * weights).sum(1) + bias
            top = logits.max(1)
            want = want + logits[np.arange(len(at)), true] - top - np.log(np.exp(logits - top[:, None]).sum(1))
        assert np.allclose(scoring.log_likelihoods(p, stream, at).astype(float), want.astype(float), rtol=1e-4, atol=1e-3)
        trainer = scoring.Trainer(p)
        trainer.step(stream, at)
        assert all(np.isfinite(v).all() for v in trainer.p.values())


def test_gradient_matches_differences():
    rng = np.random.default_rng(2)
    p = {n: rng.normal(size=v.shape).astype(np.float64) * 0.3 for n, v in scoring.initial().items()}
    stream = rng.integers(0, 40, 30)
    at = np.arange(2, 28)
    seen = {}

    class Spy(scoring.Trainer):
        def _apply(self, name, gradient):
            seen[name] = gradient

    spy = Spy(p, rate=0.0)
    spy.step(stream, at)
    for name in ("group", "group_bias", "member", "member_bias", "shift", "near_bias"):
        place = tuple(int(rng.integers(0, s)) for s in p[name].shape)
        if name in ("member_bias", "shift"):
            place = (int(stream[5]) // scoring.GROUPS, *place[1:])
        step = 1e-5
        values = []
        for sign in (1, -1):
            q = {n: v.copy() for n, v in p.items()}
            q[name][place] += sign * step
            values.append(-scoring.log_likelihoods(q, stream, at).sum())
        assert abs((values[0] - values[1]) / (2 * step) - seen[name][place]) < 1e-3


def test_trained_scores(spark, documents):
    rng = random.Random(3)
    heads, tails = [f"h{k}" for k in range(20)], [f"t{k}" for k in range(20)]

    def sentence(n):
        out = []
        for _ in range(n):
            k = rng.randrange(20)
            out += [heads[k], "is", tails[k]]
        return out

    rows = [(k, " ".join(sentence(40))) for k in range(200)]
    docs = documents(rows).repartition(3).cache()
    words = scoring.vocabulary(docs)
    assert words[0] == b"is" and len(words) == 41
    parameters = scoring.train(docs, words, stride=2)
    real = sentence(200)
    mixed = list(real)
    rng.shuffle(mixed)
    odd = documents([(1, " ".join(real)), (2, " ".join(mixed)), (3, None), (4, ""), (None, "h1 is t1"), (6, "neverseen " * 30_000)])
    out = {r["doc_id"]: r for r in scoring.score(odd.withColumn("log_prob", odd.doc_id), words, parameters).collect()}
    assert out[1]["mean_log_prob"] > out[2]["mean_log_prob"] + 0.5
    assert (out[3]["n_scored"], out[3]["log_prob"], out[3]["mean_log_prob"]) == (0, 0.0, None)
    assert out[4]["n_scored"] == 0 and out[None]["n_scored"] == 3 and out[6]["n_scored"] == 30_000
    untrained = scoring.score(odd, words, scoring.initial()).where("doc_id = 1").first()
    assert out[1]["log_prob"] > untrained["log_prob"]
    empty = documents([])
    assert scoring.vocabulary(empty) == [] and scoring.score(empty, [], scoring.train(empty, [])).count() == 0


def test_score_is_the_sum_over_places(spark, documents):
    p, words = scoring.initial(), [b"a", b"b"]
    numbers = scoring.WordNumbers(words)
    ids = [numbers[w] for w in b"a b zz A b".lower().split()]
    stream = np.array([0, 0, *ids, 0, 0])
    want = float(scoring.log_likelihoods(p, stream, np.arange(2, 7)).sum())
    row = scoring.score(documents([(1, "a b zz A b")]), words, p).first()
    assert abs(row["log_prob"] - want) < 1e-4


def test_every_word_has_its_own_probability(spark, documents):
    rng = random.Random(7)
    frequent = [f"f{k}" for k in range(scoring.WORDS)]
    rows = [(k, " ".join(frequent * 2)) for k in range(2)] + [(9, None), (10, "")]
    rows += [(100 + k, " ".join(rng.choices([f"r{j}" for j in range(60)], k=30))) for k in range(20)]
    docs = documents(rows).repartition(3).cache()
    counts = scoring.word_counts(docs).cache()
    words, p = scoring.vocabulary(docs, counts=counts), scoring.initial(1)
    assert words == scoring.vocabulary(docs)
    every = Counter(w for _, t in rows for w in (t or "").encode().split())
    number = scoring.WordNumbers(words)
    rare = {w: n for w, n in every.items() if w not in set(words)}
    totals = Counter()
    for w, n in rare.items():
        totals[number[w]] += n

    def more(text):
        out = 0.0
        for w in (text or "").lower().encode().split():
            if w not in set(words):
                out += math.log((every[w] + 257.0 ** -(len(w) + 1)) / (totals[number[w]] + 1))
        return out

    asked = rows + [(200, "R1 never-seen r2 r2"), (None, "r3 f1"), (None, "r4"), (100, "r5 r5")]
    table = documents(asked).repartition(4)
    plain = sorted((str(r[0]), r[1], r[2]) for r in scoring.score(table, words, p, keep_columns=["doc_id"]).collect())
    whole = scoring.score(table, words, p, keep_columns=["doc_id"], counts=counts)
    assert whole.columns == ["doc_id", "n_scored", "log_prob", "mean_log_prob"]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in whole.collect())
    want = Counter((str(k), len((t or "").split()), round(more(t), 6)) for k, t in asked)
    base = {(k, n): v for k, n, v in plain if (k, n) != ("None", 1)}
    assert len(got) == len(asked) and len(rare) > 60
    for key, n, value, mean in got:
        assert mean == (value / n if n else None)
        if (key, n) in base:
            assert min(abs(value - base[key, n] - m) for (a, b, m) in want if (a, b) == (key, n)) < 1e-4
    # A word that occurs once scores lower than a frequent one of its class.
    assert more("never-seen") < more("r1")
    assert scoring.score(documents([]), words, p, counts=counts).count() == 0


def test_every_word_is_a_target_once(spark, documents, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(rng.choice([0, 1, 2, 7, 60])))) for k in range(40)]
    words = sorted({w.encode() for _, t in rows for w in t.split()})[: scoring.WORDS - 1 - scoring.OTHERS]
    assert len(words) > 300
    folder = str(tmp_path)

    class Noted(scoring.Trainer):
        def step(self, stream, at):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                out.write(" ".join(map(str, stream[at].tolist())))

    monkeypatch.setattr(scoring, "Trainer", Noted)
    source = [pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])]

    class Docs:
        """Runs the tasks of ``train`` here, so that their steps can be noted."""

        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda value: type("Shared", (), {"value": value}))

        def select(self, *_):
            return self

        groupBy = applyInArrow = orderBy = select

        def mapInArrow(self, work, _):
            list(work(iter(source)))
            return self

        def collect(self):
            return []

    monkeypatch.setattr(scoring.F, "pmod", lambda *_: None)
    monkeypatch.setattr(scoring.F, "lit", lambda *_: None)
    scoring.train(Docs(), words)
    numbers = scoring.WordNumbers(words)
    found = Counter(int(x) for f in tmp_path.iterdir() for x in f.read_text().split())
    assert found == Counter(numbers[w.encode()] for _, t in rows for w in t.split())


def test_registered_training_scores(spark, documents):
    rng = random.Random(9)
    pairs = [(f"h{k}", f"t{k}") for k in range(20)]
    docs = documents([(k, " ".join(f"{h} is {t}" for h, t in rng.choices(pairs, k=40))) for k in range(200)]).repartition(3).cache()
    counts = scoring.word_counts(docs).cache()
    words = scoring.vocabulary(docs, counts=counts)
    real = [w for h, t in rng.choices(pairs, k=200) for w in (h, "is", t)]
    mixed = rng.sample(real, len(real))
    asked = documents([(1, " ".join(real)), (2, " ".join(mixed))])
    out = {r["doc_id"]: r["mean_log_prob"] for r in scoring.score(asked, words, scoring.train(docs, words), counts=counts).collect()}
    assert out[1] > out[2] + 0.5


def test_scores_carry_columns_named_like_temporaries(spark, documents, tmp_path):
    documents([(k, f"alpha beta w{k} gamma") for k in range(6)] + [(9, None)]).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    counts = scoring.word_counts(docs)
    words, parameters = [b"alpha", b"beta"], scoring.initial()
    plain = {r["doc_id"]: r["log_prob"] for r in scoring.score(docs, words, parameters, counts=counts).collect()}
    names = ["__text", "__chunk", "__At", "__others", "__more"]
    more = docs.selectExpr("*", *[f"doc_id + {k} AS {n}" for k, n in enumerate(names)])
    out = scoring.score(more, words, parameters, counts=counts)
    assert out.columns == [*more.columns, "n_scored", "log_prob", "mean_log_prob"]
    rows = out.collect()
    assert {r["doc_id"]: r["log_prob"] for r in rows} == pytest.approx(plain)
    assert len(rows) == 7 and all(r[n] == r["doc_id"] + k for r in rows for k, n in enumerate(names))
