"""Sequential kernels and corpus questions."""

import difflib
import random

import numpy as np
import pytest

from scriptorium.operators import dedupe, kernels, linking, rules
from scriptorium.plans import ask


def test_jaro_winkler_of_known_pairs():
    assert kernels.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert kernels.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert kernels.jaro_winkler("", "a") == 0.0 and kernels.jaro_winkler("a", "a") == 1.0


def test_similar_lines_like_the_plain_version():
    r = random.Random(1)
    lines = ["".join(r.choice("ab c") for _ in range(30)) for _ in range(6)]
    lines += [x[:-1] + "z" for x in lines] + lines + ["", "  "]
    keys = []
    kept = []
    for i, line in enumerate(lines):
        key = " ".join(line.lower().split())
        if key and key not in keys and all(difflib.SequenceMatcher(None, o, key, autojunk=False).ratio() < 0.92 for o in keys[-10:]):
            keys.append(key)
            kept.append(i)
    assert kernels.fresh_lines(lines) == kept


def test_budget_passes_over_what_is_too_large():
    assert kernels.within_budget([5, 9, 4, 1], 10, 6) == [0, 2, 3]
    assert kernels.within_budget([1, 1, 1], 10, 2) == [0, 1]


def test_windows_and_clusters():
    assert kernels.best_window("hello wonderful world", "say hello wonderful world now") == 1.0
    assert kernels.best_window("hello wonderful world", "say HELLO  wonderfal world now") > 0.9
    r = random.Random(3)
    for _ in range(60):
        needle, hay = ("".join(r.choice("ab c") for _ in range(r.randint(12, 40))).strip() for _ in range(2))
        needle, hay = " ".join(needle.split()), " ".join((hay + needle[5:] + hay).split())
        ratios = [difflib.SequenceMatcher(None, hay[at : at + size], needle, autojunk=False).ratio() for size in (len(needle) * p // 100 for p in (80, 100, 120)) for at in {*range(0, max(0, len(hay) - size), max(1, len(needle) // 4)), max(0, len(hay) - size)}]
        want = 0.0 if len(needle) < 10 else 1.0 if needle in hay else max(ratios)
        assert kernels.best_window(needle, hay, 1.0) == want
        assert kernels.best_window(needle, hay) >= min(want, 0.95)
    assert kernels.best_window("short", "short") == 0.0
    assert kernels.centroid_clusters(np.array([[1, 0], [0.9, 0.1], [0, 1], [-1, 0]], float), 0.8, 2) == [0, 0, 1, 1]


def test_cooccurrence_of_entities_of_seven_letters(spark):
    docs = spark.createDataFrame([(1, "Abcdefg and Hijklmno"), (2, "Hijklmno, Abcdefg, Abcdef")], "doc_id long, text string")
    assert [tuple(x) for x in linking.cooccurrence(docs).collect()] == [("abcdefg", "hijklmno", 2, 2)]


def test_greedy_deduplication_like_brute_force(spark):
    r = random.Random(7)
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(80)})
    kept = []
    for i in range(60):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    frame = spark.createDataFrame(pairs, "doc_a long, doc_b long")
    got = rules.greedy_kept(frame, spark.range(60))
    assert sorted(x.id for x in got.collect()) == kept
    assert rules.greedy_kept(frame.limit(0), spark.range(3)).count() == 3


def test_jaccard_pairs_like_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.sample(words, 20)) for _ in range(15)]
    texts += [" ".join(t.split()[:-1] + ["x"]) for t in texts] + texts[:3]
    docs = list(enumerate(texts))
    got = {(x.doc_a, x.doc_b) for x in dedupe.jaccard_pairs(spark.createDataFrame(docs, "doc_id long, text string"), 0.85).collect()}
    first = {}
    for i, t in docs:
        first.setdefault(frozenset(t.split()), i)
    assert got == {(a, b) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) / len(s | t) >= 0.85}


def test_questions(spark):
    docs = spark.createDataFrame([(1, "Amount: $1,000\nAmount: 50", "en", "s", 26), (2, "x", "de", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert ask.answer(docs, "How many German documents are there?").first().answer == 1
    assert ask.answer(docs, "how many have more than 5 characters").first().answer == 1
    assert ask.answer(docs, 'What is the total "amount"?').first().answer == 1050.0
    assert [x.doc_id for x in ask.answer(docs, "list all documents, top 1").collect()] == [1]
    assert not ask.is_corpus_question("why is the sky blue") and ask.parse("top 3 with >= 5 years").comparisons == [(">=", 5.0)]
    with pytest.raises(ValueError, match="corpus"):
        ask.answer(docs, "hello")
