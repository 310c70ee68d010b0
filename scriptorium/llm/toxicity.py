"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts, their labels unseen, are the unlabelled ones.  A linear model over
the presence of words minimises  prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),  the risk that
positives and the class prior stand for; when the second part falls below zero the step goes the other way, so that the
model cannot gain by calling every unlabelled text clean.

Features are whole words and word beginnings (stems of 3 to 8 letters).  Those that may carry weight stand in clearly
more different contexts (pairs with the next word) among positives than among unlabelled texts; contexts, not texts, are
counted so that copies of one text count once.

Defined results: null and empty texts have no words and get the score of the bias alone; without positives or unlabelled
texts every score is 0; repeated rows each get their result; a document with differing labels counts as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, small, table, tune
from .sampling import bounded_texts

#: About so many confirmed and unlabelled texts, and so many bytes of each, are learned from.
MAX_POSITIVE, MAX_UNLABELLED, MAX_BYTES = 1500, 5000, 64 << 20
#: Features: at least so many contexts among positives, so many standard deviations above the unlabelled rate, and so
#: many times that rate.
LEAST_CONTEXTS, LEAST_Z, LEAST_LIFT, MAX_FEATURES = 6, 5.0, 2.5, 3000
#: Lengths of word beginnings; 0 is the whole word.
SIZES = (0, 3, 4, 5, 6, 7, 8)
#: Words whose features a worker remembers.
CACHE_WORDS = 200_000
STEPS, RATE, DECAY, BATCH, KEEP = 2500, 0.05, 2e-5, 512, 0.5

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features_of(word: str, sizes: Iterable[int] = SIZES) -> list[str]:
    """Beginnings of the word by length, and the word itself (size 0) with an end mark."""
    return [word[:n] if n else word + "$" for n in sizes if n < len(word)]


def contexts(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The words, and of each the number of different next words it stands before."""
    ids: dict[str, int] = {}
    pairs = np.zeros(0, np.int64)
    for at in range(0, len(texts), 500):  # merged run by run, so that only distinct pairs are held
        found = [pairs]
        for text in texts[at : at + 500]:
            row = np.array([ids.setdefault(w, len(ids)) for w in words_of(text)], np.int64)
            found.append(row << 32 | np.append(row[1:] + 1, 0)) if len(row) else None
        pairs = np.unique(np.concatenate(found))
    return list(ids), np.bincount(pairs >> 32, minlength=len(ids))


def select(positive: list[str | None], unlabelled: list[str | None]) -> list[str]:
    (words_p, of_p), (words_u, of_u) = contexts(positive), contexts(unlabelled)
    # Where few words make up all texts, pairs repeat and their numbers say little; then the numbers of texts count.
    rate = min(of_p.sum() / max(int(of_u.sum()), 1), len(positive) / len(unlabelled))
    chosen = []
    for size in SIZES:
        in_p: dict[str, int] = {}
        for word, n in zip(words_p, of_p.tolist(), strict=True):
            for f in features_of(word, (size,)):
                in_p[f] = in_p.get(f, 0) + n
        in_p = {f: n for f, n in in_p.items() if n >= LEAST_CONTEXTS}
        in_u = dict.fromkeys(in_p, 0)
        for word, n in zip(words_u, of_u.tolist(), strict=True):
            for f in features_of(word, (size,)):
                if f in in_u:
                    in_u[f] += n
        for f, n in in_p.items():
            expected = (in_u[f] + 0.5) * rate
            if (z := (n - expected) / np.sqrt(expected + 1)) >= LEAST_Z and n >= LEAST_LIFT * expected:
                chosen.append((-z, f))
    return [f for _, f in sorted(chosen)[:MAX_FEATURES]]


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.weights = dict(zip(features, weights.tolist(), strict=True))
        self.bias = bias
        self._of_word: dict[str, tuple[str, ...]] = {}

    def present(self, text: str | None) -> set[str]:
        """The features that occur in the text."""
        have, known, found = self.weights, self._of_word, set()
        for word in set(words_of(text)):
            of = known.get(word)
            if of is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                of = known[word] = tuple(f for f in features_of(word) if f in have)
            if of:
                found.update(of)
        return found

    def score(self, text: str | None) -> float:
        logit = self.bias + sum(self.weights[f] for f in sorted(self.present(text)))
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def train(positive: list[str | None], unlabelled: list[str | None], prior: float, seed: int = 5) -> Model | None:
    """None if there is nothing to learn from."""
    if not positive or not unlabelled or prior <= 0:
        return None
    features = select(positive, unlabelled)
    at = {f: i for i, f in enumerate(features)}
    finder = Model(features, np.zeros(len(features)), 0.0)

    def matrix(texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(features)), np.uint8)
        for row, text in enumerate(texts):
            x[row, [at[f] for f in finder.present(text)]] = 1
        return x

    p, u = matrix(positive), matrix(unlabelled)
    firsts: dict[str, int] = {}
    groups = np.array([firsts.setdefault(f[:3], len(firsts)) for f in features], np.int64)
    if not features:
        return Model([], np.zeros(0), float(np.log(prior / (1 - prior))) if prior < 1 else 60.0)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(features)), 0.0
    first, second = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -60, 60)))
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)].astype(np.float32), u[rng.integers(0, len(u), BATCH)].astype(np.float32)
        # Half the features are hidden at random, so that each must be told by itself; a word's stems go together.
        xp, xu = xp * (rng.random((len(xp), groups.max() + 1)) < KEEP)[:, groups], xu * (rng.random((len(xu), groups.max() + 1)) < KEEP)[:, groups]
        gp, gu = xp @ w + b, xu @ w + b
        # The sigmoid loss: loss(+) = sigmoid(-g), loss(-) = sigmoid(g); their slopes are bell-shaped and bounded.
        clean = sigmoid(gu).mean() - prior * sigmoid(gp).mean()
        of_u, of_p_clean = sigmoid(gu) * sigmoid(-gu) / len(gu), prior * sigmoid(gp) * sigmoid(-gp) / len(gp)
        of_p_toxic = -of_p_clean
        if clean >= 0:
            sp, su = of_p_toxic - of_p_clean, of_u
        else:  # the corrected risk went negative: climb out of it
            sp, su = of_p_clean, -of_u
        slope = np.append(xp.T @ sp + xu.T @ su + DECAY * w, sp.sum() + su.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(features, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, candidates: DataFrame) -> Model | None:
    """``labels``: doc_id, label 0/1; ``candidates``: the rows (doc_id, text) that unlabelled texts may come from.

    The class prior is the share of toxic ones among the labelled; beyond that only the toxic ones' labels are used.
    """
    truth = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    n, toxic = truth.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    texts = docs.select("doc_id", "text")
    confirmed = texts.join(small(truth.where("label = 1").select("doc_id")), "doc_id")

    def take(rows: DataFrame, most: int, salt: int) -> list[str | None]:
        found = bounded_texts(rows, "doc_id", most, MAX_BYTES, salt).toArrow().to_pylist()
        return [r["text"] for r in sorted(found, key=lambda r: (r["doc_id"], r["text"] or ""))]

    return train(take(confirmed, MAX_POSITIVE, 1), take(candidates.select("doc_id", "text").where("doc_id is not null"), MAX_UNLABELLED, 2), toxic / n if n else 0.0)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) if model else 0.0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod("doc_id", 3)
    labels = table(spark, sf_dir, "labels").where(fold != 1).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels, docs.where(fold != 1))
    return score(docs, model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
