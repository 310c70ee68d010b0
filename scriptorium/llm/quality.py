"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Random indexing gives each token a fixed sparse vector of +1 and -1 derived from a hash; a token's context vector is the
sum of the index vectors of its neighbours, over the whole corpus: counts and sums are worked out where the texts are.
A document is the mean of its tokens' context and index vectors.  Tokens are lowered words, runs of punctuation, and marks for what words do not say: capitals, a word repeated at once, a line seen
before, a rare word.  The network (tanh layer, logistic output) is trained by Adam; one temperature, fitted on rows kept
aside, calibrates its probabilities.

Defined results: null and empty texts have a zero vector and get the network's score for it; without labelled rows, or
with one class only, every score is that class's share (0.5 without rows); repeated rows each get their result; repeated
labels of a document count once (the smallest).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, small, table, tune
from .sampling import bounded_texts

#: About so many labelled documents, and so many bytes of them, are learned from.
MAX_LABELLED, MAX_BYTES = 5000, 64 << 20
#: Longer tokens are rare ones.
LONGEST_TOKEN = 64
#: Tokens that a worker counts before it passes the counts on, and whose neighbours it adds up at once.
COUNTED, RUN = 300_000, 200_000
VOCABULARY, DIMENSIONS, NONZERO, WINDOW = 20_000, 64, 8, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4

_TOKEN = re.compile(r"\w+|[^\w\s]+")
CAPITALS, AGAIN, LINE_AGAIN, RARE = "<capitals>", "<again>", "<line again>", "<rare>"


def tokens_of(text: str | None) -> list[str]:
    out: list[str] = []
    seen: set[int] = set()
    for line in (text or "").split("\n"):
        found = _TOKEN.findall(line)
        key = hash(line)
        if line and key in seen:
            out.extend([LINE_AGAIN] * len(found))
        seen.add(key)
        before = None
        for token in found:
            low = token.lower()
            if low != token and len(token) > 1 and token.isupper():
                out.append(CAPITALS)
            if low == before:
                out.append(AGAIN)
            before = low
            out.append(low)
    return out


def index_vector(token: str) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token))
    vector = np.zeros(DIMENSIONS, np.float32)
    vector[rng.permutation(DIMENSIONS)[:NONZERO]] = np.where(rng.random(NONZERO) < 0.5, -1, 1)
    return vector


def vocabulary(docs: DataFrame) -> list[str]:
    """The VOCABULARY tokens that most texts have, if more than one has them; ties in order of the token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column("text"):
                counts.update(t for t in set(tokens_of(text.as_py())) if len(t) <= LONGEST_TOKEN)
                if len(counts) > COUNTED:
                    yield rows()
                    counts.clear()
        yield rows()

    found = docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r["token"] for r in found.where((F.col("n") > 1) & (F.col("token") != RARE)).orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()]


class Index:
    """Row and index vector of each token of the vocabulary; row 0 is what is rare."""

    def __init__(self, tokens: list[str]):
        self.at = {t: i + 1 for i, t in enumerate(tokens)}
        self.vectors = np.array([index_vector(t) for t in [RARE, *tokens]])
        # Where the entries of each vector are that are not zero, and which; what stands between documents has none.
        spots = np.argsort(self.vectors == 0, axis=1, kind="stable")[:, :NONZERO]
        self.spots = np.vstack([spots, np.zeros(NONZERO, np.int64)])
        self.signs = np.vstack([np.take_along_axis(self.vectors, spots, axis=1), np.zeros(NONZERO)])

    def neighbours(self, documents: list[np.ndarray]) -> np.ndarray:
        """Sum of the neighbours' index vectors, a row for each token."""
        gap = len(self.vectors)  # stands between documents; its own row is left out in the end
        width = gap + 1
        ids = np.concatenate([np.append(d, [gap] * WINDOW) for d in documents])
        # Neighbours repeat: each pair of tokens is added once, times its number.
        pairs, times = np.unique(np.concatenate([ids[step:] * width + ids[:-step] for step in range(1, WINDOW + 1)]), return_counts=True)
        left, right = np.divmod(pairs, width)
        total = np.zeros(width * DIMENSIONS)
        for own, other in ((left, right), (right, left)):
            total += np.bincount((own[:, None] * DIMENSIONS + self.spots[other]).ravel(), (self.signs[other] * times[:, None]).ravel(), len(total))
        return total.reshape(gap + 1, DIMENSIONS)[:gap].astype(np.int64)


def contexts(docs: DataFrame, index: Index) -> np.ndarray:
    """Context vectors of the vocabulary over all texts; whole numbers, so that the order of adding does not matter."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, size = shared.value, [], 0
        total = np.zeros(index.vectors.shape, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                tokens = tokens_of(text.as_py())
                for at in range(0, len(tokens), RUN):  # runs overlap by nothing: the pairs across a cut are added apart
                    held.append(np.array([index.at.get(t, 0) for t in tokens[at : at + RUN]], np.int64))
                    size += len(held[-1])
                    if at:
                        edge = np.array([index.at.get(t, 0) for t in tokens[at - WINDOW : at + WINDOW]], np.int64)
                        total += index.neighbours([edge]) - index.neighbours([edge[:WINDOW], edge[WINDOW:]])
                    if size >= RUN:
                        total += index.neighbours(held)
                        held, size = [], 0
        if held:
            total += index.neighbours(held)
        used = np.flatnonzero(total.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), DIMENSIONS).cast(pa.list_(pa.int64()))], ["token", "sums"])

    rows = docs.select("text").mapInArrow(add, "token long, sums array<long>")
    found = rows.groupBy("token").agg(F.array(*(F.sum(F.col("sums")[k]) for k in range(DIMENSIONS))).alias("sums")).toArrow()
    total = np.zeros(index.vectors.shape, np.float32)
    if found.num_rows:
        total[found["token"].to_numpy()] = found["sums"].combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    return total


class Vectors:
    """Context and index vectors of the vocabulary, side by side."""

    def __init__(self, index: Index, context: np.ndarray):
        self.at = index.at
        context = context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        self.table = np.hstack([context, index.vectors / np.sqrt(NONZERO)]).astype(np.float32)

    def ids(self, tokens: list[str]) -> np.ndarray:
        at = self.at
        return np.array([at.get(t, 0) for t in tokens], np.int64)

    def pooled(self, text: str | None) -> np.ndarray:
        tokens = tokens_of(text)
        if not tokens:
            return np.zeros(self.table.shape[1], np.float32)
        counts = np.bincount(self.ids(tokens), minlength=1)
        used = np.flatnonzero(counts)
        return (counts[used] @ self.table[used]) / len(tokens)


class Network:
    """Standardised input, one tanh layer, a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.constant = None
        self.temperature = 1.0
        if len(y) < 2 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        aside = rng.random(len(y)) < 0.2
        if aside.all() or not aside.any() or y[~aside].min() == y[~aside].max():
            aside = np.zeros(len(y), bool)
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self._train(x[~aside], y[~aside], rng)
        if aside.any():
            logits, truth = self._logits(x[aside]), y[aside]
            grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            self.temperature = float(min(grid, key=lambda t: np.logaddexp(0, np.where(truth > 0, -logits, logits) / t).mean()))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        first, second, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for rows in np.split(order, range(BATCH, len(y), BATCH)):
                hidden = np.tanh(x[rows] @ self.p[0] + self.p[1])
                error = (1 / (1 + np.exp(-(hidden @ self.p[2] + self.p[3]))) - y[rows]) / len(rows)
                back = np.outer(error, self.p[2]) * (1 - hidden**2)
                slopes = [x[rows].T @ back + DECAY * self.p[0], back.sum(axis=0), hidden.T @ error + DECAY * self.p[2], np.array([error.sum()])]
                step += 1
                for i, g in enumerate(slopes):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.p[i] = self.p[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-self._logits((x - self.mean) / self.scale) / self.temperature))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[Vectors, Network]:
    """Word vectors from all texts of ``docs``; the network from about ``most`` rows that ``labels`` (doc_id, label 0/1) name."""
    tune(docs.sparkSession)
    truth = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    index = Index(vocabulary(docs))
    vectors = Vectors(index, contexts(docs, index))
    named = docs.select("doc_id", "text").join(small(truth), "doc_id")
    rows = bounded_texts(named, "doc_id", most, MAX_BYTES).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    x = np.array([vectors.pooled(r["text"]) for r in rows]).reshape(len(rows), vectors.table.shape[1])
    return vectors, Network(x, np.array([float(r["label"]) for r in rows]))


def score(docs: DataFrame, model: tuple[Vectors, Network]) -> DataFrame:
    """doc_id and score of every row; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            x = np.array([vectors.pooled(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, vectors.table.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(network.scores(x), pa.float64())], ["doc_id", "score"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), crc32_mod("doc_id", 5)
    labels = table(spark, sf_dir, "labels").where(fold != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
