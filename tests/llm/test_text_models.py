"""Language, quality, toxicity: held-out accuracy on made-up data, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import language_id, quality, toxicity

SYLLABLES = {"aa": ["the", "ing", "ton", "er"], "bb": ["ße", "lich", "ung", "ver"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    return [(i, prose(r, lang := r.choice(["aa", "bb"]), r.randint(5, 60)), lang) for i in range(400)]


def test_language_is_told_on_held_out_texts(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 4 <> 2"))
    assert model.langs == ["aa", "bb"]
    got = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in corpus if i % 4 == 2)
    # A word never seen is told by its n-grams.
    assert language_id.Scorer(model).predict("lichverung")[0] == "bb"


def test_language_model_makes_no_object_for_each_row(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    kind, sizes = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (rows := collect(self), sizes.append(len(rows)))[0])
    assert len(language_id.fit(docs).logs) > 100
    assert max(sizes) <= 2  # languages


def test_language_edge_cases(spark, corpus):
    docs = spark.createDataFrame([*corpus, (900, "the the", None), (901, None, "aa"), (902, "12 !?", "aa"), (903, "", "aa"), (904, "漢字", None), (905, "the " * 50_000, "aa")], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.fit(docs)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(docs, model).collect()}
    assert got[901] == got[902] == got[903] == ("und", 0.0)
    assert language_id.Scorer(model).predict("½ ²") == ("und", 0.0)
    assert got[900][0] == got[905][0] == "aa"
    assert got[904][0] in ("aa", "bb")
    kept = language_id.keep_known(docs, model, 0.3)
    assert kept.columns == docs.columns
    assert {901, 902, 903}.isdisjoint(x.doc_id for x in kept.collect())
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language_id.fit(empty)
    assert language_id.identify(empty, nothing).count() == 0
    assert language_id.Scorer(nothing).predict("the") == ("und", 0.0)


def test_quality_on_held_out_texts(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        text = prose(r, "aa", r.randint(20, 60))
        bad = r.random() < 0.3
        if bad:
            text = r.choice([text.upper(), " | ".join(text.split()), " ".join([text.split()[0]] * 30)])
        rows.append((i, text))
        labels.append((i, int(not bad)))
    rows += [(1000, None), (1001, ""), (1002, "the " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    truth = spark.createDataFrame([*labels, (1000, 1), (77777, 0), (3, None), (None, 1)], "doc_id long, label int")
    got = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs, truth.where("doc_id % 5 <> 0"))).collect()}
    held = [(got[i], y) for i, y in labels if i % 5 == 0]
    assert sum((s >= 0.5) == (y == 1) for s, y in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)


def test_quality_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, label int")
    assert {x.score for x in quality.score(docs, quality.fit(docs, empty)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    assert {x.score for x in quality.score(docs, quality.fit(docs, ones)).collect()} == {1.0}
    assert quality.score(docs.limit(0), quality.fit(docs, empty)).count() == 0


def test_toxicity_on_held_out_texts(spark):
    r = random.Random(9)
    bad = ["vermin", "gross", "fool", "dunce"]
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(r, "aa", r.randint(20, 60)).split(), r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    truth = spark.createDataFrame([x for x in labels if not held(x[0])], "doc_id long, label int")
    got = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, truth, docs.where("doc_id < 900"))).collect()}
    assert sum((got[i] >= 0.7) == (y == 1) for i, y in labels if held(i)) >= 0.97 * sum(held(i) for i, _ in labels)
    assert got[1000] == got[1001] < 0.7 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, label int"), docs)
    assert model is None
    assert [x.score for x in toxicity.score(docs, model).collect()] == [0.0] * 3


def test_languages_like_a_plain_version(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    model = language_id.fit(docs)

    def plain(text):
        total = np.zeros(2)
        words = language_id.words_of(text)
        for word in words:
            for n in (0, 4, 3, 2, 1):
                grams = [word] if n == 0 else [("^" + word + "$" if n > 1 else word)[i : i + n] for i in range(len(word) + (3 if n > 1 else 1) - n)]
                known = [model.logs[model.tables[n][g]] for g in grams if g in model.tables.get(n, {})]
                if known:
                    total += np.mean(known, axis=0)
                    break
        chances = np.exp((total - total.max()) / max(1, len(words) ** 0.5))
        return model.langs[int(total.argmax())], chances.max() / chances.sum()

    got = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    for i, text, _ in corpus:
        lang, score = plain(text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, rel=1e-4)


def test_word_vectors_like_a_plain_version(spark, monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "b", "C", "c", ",", "dd"]) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(quality, "RUN", 7)
    monkeypatch.setattr(quality, "COUNTED", 3)
    tokens = [quality.tokens_of(t) for t in texts]
    counts = {t: sum(t in d for d in tokens) for d in tokens for t in d}
    kept = sorted((t for t, n in counts.items() if n > 1), key=lambda t: (-counts[t], t))
    assert quality.vocabulary(docs) == kept
    index = quality.Index(kept)
    want = np.zeros(index.vectors.shape)
    for d in tokens:
        ids = [index.at.get(t, 0) for t in d]
        for i, own in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                want[own] += index.vectors[ids[j]] if j != i else 0
    assert (quality.contexts(docs, index) == want).all()


def test_toxicity_scores_like_a_plain_version(spark):
    model = toxicity.Model(["bad", "fool$", "foo", "verm"], np.array([1.5, 2.0, -0.5, 3.0]), -1.0)
    texts = ["bad", "Badly fool", "fool foo food", "vermin VERM", None, "", "nothing here"]
    got = {x.doc_id: x.score for x in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        has = lambda f: any(w + "$" == f or (w.startswith(f) and len(w) > len(f)) for w in words)  # noqa: B023, E731
        logit = -1.0 + sum(w for f, w in model.weights.items() if has(f))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-logit)))
