"""Language ID and toxicity: held-out accuracy, what they learn from, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import language as lang
from cliploom.llm import sampling
from cliploom.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def rest(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = lang.op2_language(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95


def test_language_bundles_equal_their_definition():
    text, n, dim = "Été Ab", 3, lang.DIM
    code = [0, *map(ord, "été"), 0, *map(ord, "ab"), 0]
    want = np.zeros(dim)
    for i in range(len(code) - n + 1):
        v = np.ones(dim)
        for k in range(n):
            v *= np.roll(lang.letter_vectors(np.array([code[i + k]]), dim)[0], n - 1 - k)
        want += v
    got, letters = lang.bundles([None, "12 !", text, ""])
    assert np.array_equal(got[2], want) and letters.tolist() == [0, 0, 5, 0]
    many = ["".join(chr(0x4E00 + (i * 7 + j) % 900) for j in range(500)) for i in range(5)]
    whole, _ = lang.bundles(many)
    assert all(np.array_equal(whole[i], lang.bundles([t])[0][0]) for i, t in enumerate(many))


def test_language_edges(spark, docs):
    train = docs({1: "the cat and the dog and the house", 2: "der Hund und die Katze und das Haus", 3: "the tree and the sea", 5: None})
    p = lang.learn(train.withColumn("lang", F.when(F.col("doc_id") == 3, None).otherwise(F.col("lang"))), "doc_id", "text", "lang")
    assert p.languages == ["de", "en"]
    got = {(r.doc_id, r.lang_pred, r.score > 0) for r in lang.predict(docs([(1, "the dog"), (2, "und das"), (3, None), (4, ""), (5, "12-3"), (None, "the sea"), (1, "the dog")]), p).collect()}
    assert got == {(1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "en", True)}
    assert lang.predict(docs({}), p).collect() == []
    nothing = lang.learn(docs({}), "doc_id", "text", "lang")
    assert [(r.lang_pred, r.score) for r in lang.predict(docs({1: "text"}), nothing).collect()] == [("und", 0.0)]


def test_keep_known_keeps_short_texts(spark, docs):
    """Short clean texts whose cosine is as low as noise stay; null and letterless texts go."""
    p = lang.learn(docs({1: "the cat and the dog and the house", 2: "der Hund und die Katze und das Haus"}), "doc_id", "text", "lang")
    rows = docs({1: "Avec.", 2: "A.", 3: None, 4: "12-3", 5: "xyzzy", 6: "the dog"})
    assert min(r.score for r in lang.predict(rows, p).collect() if r.lang_pred != "und") < lang.MIN_SCORE
    assert sorted(r.doc_id for r in lang.keep_known(rows, p).collect()) == [1, 2, 5, 6]


def test_all_languages_are_learnt(spark):
    """300 languages, in one block and in several; prediction equals brute force over all prototypes."""
    say = lambda k, n: " ".join("".join(chr(0x3400 + (k * 31 + j * 7 + i) % 3000) for j in range(4)) for i in range(n))
    rows = [(k * 2 + r, say(k, 5 + r), f"l{k:03d}") for k in range(300) for r in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = lang.learn(frame, "doc_id", "text", "lang")
    assert len(p.languages) == 300
    sums = {}
    for _, text, name in rows:
        sums[name] = sums.get(name, 0) + lang.bundles([text])[0][0].astype(np.float64)
    names = sorted(sums)
    table = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    want = {}
    for i, text, _ in rows:
        v = lang.bundles([text])[0][0].astype(np.float64)
        want[i] = names[int(np.argmax(table @ (v / np.linalg.norm(v))))]
    for block in (4096, 64):
        got = lang.predict(frame, p, {"more": F.lit(1)}, block=block)
        assert got.columns == ["doc_id", "lang_pred", "score", "more"]
        assert {r.doc_id: r.lang_pred for r in got.collect()} == want


def test_samples_are_bounded(spark):
    """Never more rows or bytes of a class than the bounds, with many rows, copies and long texts; and not many fewer."""
    rows = spark.range(200_000).selectExpr("if(id % 3 = 0, 'a', 'b') AS c", "id AS i", "if(id % 3 = 1, 'copy', concat('text ', id)) AS t").withColumn("i", F.expr("if(t = 'copy', 1, i)"))
    rows = rows.select("c", sampling.place("i", "t").alias("at"), F.octet_length("t").alias("size"))
    count = lambda found: {r.c: r["count"] for r in found.groupBy("c").count().collect()}
    got = count(sampling.least(rows, 1000))
    assert got == {"a": 1000, "b": 1000}
    got = count(sampling.least(rows, 1000, class_bytes=600))
    assert 40 < got["a"] <= 60 and 40 < got["b"] <= 60
    assert count(sampling.least(rows, 10, text_bytes=3)) == {} and count(sampling.least(rows.where("false"), 10)) == {}


def test_toxicity_scores_equal_the_definition(spark, docs, model):
    """Every passage by hand: the mean of its words' subword means, through the layer and softmax; the largest counts."""
    rng = np.random.default_rng(4)
    vocabulary = ["bane", "horrible", "dukal", "Été", "x1", "mika-ru", "unseen" * 15]
    rows = {k: " ".join(rng.choice(vocabulary, rng.integers(0, 40))) for k in range(40)}
    got = scored(spark, docs, model, rows)
    for k, text in rows.items():
        vectors = [model.embedding[tox.subwords(x)].astype(np.float64).mean(axis=0) for x in tox.split(text)]
        halves = [vectors[i : i + tox.HALF] for i in range(0, len(vectors), tox.HALF)]
        passages = [a + b for a, b in zip(halves, halves[1:], strict=False)] or halves
        best = 0.0
        logits = [model.layer.astype(np.float64) @ np.mean(p, axis=0) + model.bias for p in passages]
        if logits:
            best = max(np.exp(z[1] - z.max()) / np.exp(z - z.max()).sum() for z in logits)
        assert abs(got[k] - best) < 1e-5


def test_toxicity_training_descends_the_loss():
    """Against the loss and a numerical gradient step written out: training must lower the balanced loss of all passages."""
    texts = [("good calm kind words here", 0), ("calm good people talk", 0), ("awful horrid words here", 1), ("you awful thing", 1)]
    m = tox.train(iter(texts))

    def loss(model):
        out = 0
        for text, y in texts:
            mean = np.mean([model.embedding[tox.subwords(w)].mean(axis=0) for w in tox.split(text)], axis=0)
            z = model.layer @ mean + model.bias
            out -= np.log(np.exp(z[y] - z.max()) / np.exp(z - z.max()).sum())
        return out / len(texts)

    blank = tox.Model(np.zeros_like(m.embedding), m.layer, np.zeros(2))
    assert loss(m) < 0.1 < loss(blank)


def test_toxicity_held_out_at_more_rows(spark):
    """Precision and recall on rows that were never learnt, and on long texts."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in tox.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    caught = [r.predicted for r in rows if labels[r.doc_id] == 1]
    right = [labels[r.doc_id] for r in rows if r.predicted]
    assert np.mean(caught) > 0.7 and np.mean(right) > 0.85


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = tox.op1_toxicity(spark, SF).collect()
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.9


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    plain = [f"{a}{b}{c}" for a in ("ba", "du", "mi", "so") for b in ("ne", "ka", "ru") for c in ("l", "t", "ma", "")]
    texts = []
    for i in range(300):
        words = list(rng.choice(plain, rng.integers(3, 60)))
        if i % 3 == 0:
            words[rng.integers(len(words))] = rng.choice(["horrible", "wretched", "vile_scum".replace("_", "")])
        texts.append((" ".join(words), int(i % 3 == 0)))
    return tox.train(iter(texts))


def scored(spark, docs, model, rows):
    return {r.doc_id: r.score for r in tox.score(docs(rows), model).collect()}


def test_toxicity_misspelt_long_and_empty(spark, docs, model):
    got = scored(spark, docs, model, {1: "bane horrible dukal", 2: "bane horribble dukal", 3: "bane dukal sorut", 4: None, 5: "", 6: "bane dukal " * 30_000 + "horrible", 7: "bane dukal " * 30_000, 8: "bane " * 300})
    assert got[1] > 0.5 and got[2] > 0.5 and got[6] > 0.5
    assert max(got[k] for k in (3, 4, 5, 7, 8)) < 0.5 and got[4] == got[5]


def test_toxicity_nothing_to_learn(spark, docs):
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    m = tox.learn(docs({1: "a b", 2: "c d"}), labels, F.lit(True))
    assert scored(spark, docs, m, {1: "a b"})[1] < 0.5 and scored(spark, docs, m, {}) == {}
