import math
import random
import zlib

import numpy as np

from roadflow.llm import language

WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this have from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine größe".split(),
    "fr": "de la le et les des en un du une que est pour qui dans à par plus été où".split(),
}


def _text(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def _plain_bits(texts, order, text):
    """Code length of a text by the definition, from counts of all substrings (contexts seen at least twice)."""
    counts = {}
    everywhere = {}
    for lang, parts in texts.items():
        own = counts.setdefault(lang, {})
        for part in parts:
            for size in range(1, order + 2):
                for k in range(len(part) - size + 1):
                    gram = part[k : k + size]
                    own[gram] = own.get(gram, 0) + 1
                    everywhere[gram] = everywhere.get(gram, 0) + 1
    known = set(b"".join(p for parts in texts.values() for p in parts))
    total = {}
    for lang, own in counts.items():
        bits = 0.0
        for k, byte in enumerate(text):
            context = text[max(0, k - order) : k]
            while context and everywhere.get(context, 0) < 2:
                context = context[1:]
            reached, excluded, chance = 1.0, set(), None
            while True:
                after = {b: own[context + bytes([b])] for b in known if b not in excluded and context + bytes([b]) in own}
                n, d = sum(after.values()), len(after)
                if byte in after:
                    chance = reached * after[byte] / (n + d)
                    break
                if n:
                    reached *= d / (n + d)
                excluded |= set(after)
                if not context:
                    break
                context = context[1:]
            bits -= math.log2(chance if chance is not None else reached / (256 - len(excluded)))
        total[lang] = bits
    return total


def test_code_lengths_are_exact():
    rng = random.Random(1)
    texts = {lang: [_text(rng, lang, 40).encode() for _ in range(3)] for lang in WORDS}
    model = language.train(texts, order=3)
    for text in (_text(rng, "de", 90), "où été", "x", "\x00\x01 the", "日本語 of"):
        raw = text.encode()
        got = language.code_lengths(model, [b"", raw, raw + raw], segment=16)
        want = _plain_bits(texts, 3, raw)
        assert np.allclose(got[1], [want[x] for x in model.languages], rtol=1e-4)
        assert not got[0].any()


def test_pruning_keeps_beginnings_and_endings():
    rng = random.Random(2)
    texts = {lang: [_text(rng, lang, 400).encode()] for lang in WORDS}
    model = language.train(texts, order=4, cells=30_000)
    assert len(model.bits) * 3 <= 60_000
    assert (language.code_lengths(model, [texts["fr"][0]])[0].argmin()) == model.languages.index("fr")


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rng = random.Random(3)
    rows = [(k, _text(rng, lang := rng.choice(list(WORDS)), rng.randint(3, 60)), lang) for k in range(400)]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "en"), (1003, "日本語", None), (None, "the of and", "en"), rows[0], rows[0],
           (1004, "die größe " * 40_000, None)]
    docs = documents(rows + odd)
    model = language.learn(docs)
    assert model.languages == ["de", "en", "fr"]
    out = language.predict(docs.withColumn("score", docs.doc_id), model).collect()
    assert len(out) == len(rows) + len(odd)
    by_id = {r["doc_id"]: r for r in out}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(by_id[k]["lang_pred"] == rows[k][2] for k in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert [by_id[k]["lang_pred"] for k in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "de"]
    assert by_id[1003]["lang_pred"] in WORDS
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", language.held_out("doc_id").alias("h")).collect()}
    assert all(got[k] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400)) and got[None] is False


def test_labels_of_the_held_out_fold_are_not_learned(spark, documents):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 0)
    model = language.learn(documents([(held, "only here", "xx"), (None, "no id", "yy")]))
    assert model.languages == []
    rows = language.predict(documents([(1, "some text")]), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert language.predict(documents([]), model).count() == 0


def test_query_accuracy(spark):
    from roadflow.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op2_language"](spark, folder).collect() if r["held_out"]]
    assert len(rows) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_a_language_of_long_texts_is_learned(spark, documents):
    """Texts longer than the sample give a part; of a language with few rows one is always drawn."""
    rng = random.Random(4)
    words = {"aa": ["mama", "tata", "kaka", "papa"], "bb": ["zxq", "qzx", "xqz", "zzq"]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    rows = [(k, text("aa", 3000), "aa") for k in range(6)] + [(10 + k, text("bb", 40), "bb") for k in range(40)] + [(77, "", "cc")]
    docs = documents(rows + [(90, text("aa", 9), None), (91, text("bb", 9), None), (1, rows[1][1], "aa")])
    model = language.learn(docs, sample_bytes=4000)
    assert model.languages == ["aa", "bb"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert all(got[k] == "aa" for k in [*range(6), 90]) and all(got[10 + k] == "bb" for k in range(40)) and got[91] == "bb"
