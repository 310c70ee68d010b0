"""Language identification by words first, then by ever shorter character n-grams.

A word that a language's table knows scores by its log frequency in each language.  An unseen word is cut into character
4-grams (with marks at its ends); if none is known, into 3-grams, then pairs, then single letters.  Scores add up over
the whole text; the posterior is tempered by the square root of the number of words, so that it stays a usable score.

Defined results: null texts and texts without letters are ``und`` with score 0, as is every text if nothing was learned;
rows without a language are not learned from; equal scores go to the alphabetically first language; repeated rows each
get their result; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import crc32_mod, table, tune
from .sampling import bounded_by_class

#: About so many documents of each language are learned from.
MAX_DOCS_PER_LANG = 3000
#: Words and n-grams kept of each language (fewer if there are very many languages), most frequent first.
MAX_WORDS, MAX_GRAMS, MAX_ENTRIES = 20_000, 8_000, 400_000
LONGEST_GRAM = 4
#: Unseen words whose scores a worker remembers.
CACHE_WORDS = 60_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Per-language log frequencies; ``tables[0]`` of words, ``tables[n]`` of n-grams, each entry -> row of ``logs``."""

    def __init__(self, langs: list[str], counts: dict[int, dict[str, list[int]]], totals: dict[int, list[int]]):
        self.langs = langs
        self.tables: dict[int, dict[str, int]] = {}
        rows = []
        for n, entries in sorted(counts.items()):
            of = np.array(list(entries.values()), np.float64).reshape(len(entries), len(langs))
            size = np.array(totals[n], np.float64) + 0.5 * len(entries) + 1
            logs = np.log((of + 0.5) / size)
            self.tables[n] = {e: len(rows) + i for i, e in enumerate(entries)}
            rows.extend(logs - logs.max(axis=1, keepdims=True))
        self.logs = np.array(rows, np.float32).reshape(len(rows), len(langs))

    def unseen(self, word: str) -> np.ndarray:
        """Mean log score of the longest n-grams of which any is known; zeros if not even a letter is."""
        for n in range(LONGEST_GRAM, 0, -1):
            known = self.tables.get(n, {})
            rows = [known[g] for g in grams_of(word, n) if g in known]
            if rows:
                return self.logs[rows].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known = model.tables.get(0, {})
        self.extra: dict[str, int] = {}
        self.more = np.zeros((CACHE_WORDS, len(model.langs)), np.float32)

    def _row(self, word: str) -> int:
        at = len(self.extra)
        if at >= CACHE_WORDS:
            self.extra.clear()
            at = 0
        self.more[at] = self.model.unseen(word)
        self.extra[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        langs = self.model.langs
        # Word characters that are neither digits nor letters (a raised two, a half) make no language.
        if not langs or not any(any(map(str.isalpha, word)) for word in words):
            return UNKNOWN, 0.0
        total = np.zeros(len(langs))
        for at in range(0, len(words), 20_000):  # a run of words at a time, however long the text
            part = words[at : at + 20_000]
            rows = list(map(self.known.get, part))
            seen = [r for r in rows if r is not None]
            if seen:
                total += self.model.logs[seen].sum(axis=0, dtype=np.float64)
            if len(seen) < len(part):
                for word, r in zip(part, rows, strict=True):
                    if r is None:
                        at_extra = self.extra.get(word)
                        total += self.more[self._row(word) if at_extra is None else at_extra]
        tempered = (total - total.max()) / max(1.0, np.sqrt(len(words)))
        chances = np.exp(tempered)
        best = int(total.argmax())
        return langs[best], float(chances[best] / chances.sum())


def fit(labelled: DataFrame, max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> Model:
    """Learn from columns doc_id, text and lang; counting is distributed, the kept tables are bounded."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sample = bounded_by_class(rows, "doc_id", "lang", max_docs_per_lang)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                words.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            out = []
            for lang, of in words.items():
                grams = [Counter() for _ in range(LONGEST_GRAM + 1)]
                grams[0] = of
                for word, n in of.items():
                    for size in range(1, LONGEST_GRAM + 1):
                        for g in grams_of(word, size):
                            grams[size][g] += n
                out += [(lang, size, g, n) for size, found in enumerate(grams) for g, n in found.items()]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "size", "entry", "n"])

    tune(labelled.sparkSession)
    counts = sample.select("text", "lang").mapInArrow(count, "lang string, size int, entry string, n long").groupBy("lang", "size", "entry").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    share = MAX_ENTRIES // max(1, len(langs) * (LONGEST_GRAM + 1))
    limit = F.when(F.col("size") == 0, min(MAX_WORDS, share)).otherwise(min(MAX_GRAMS, share))
    each = W.Window.partitionBy("lang", "size")
    top = counts.withColumn("total", F.sum("n").over(each)).withColumn("place", F.row_number().over(each.orderBy(F.desc("n"), "entry"))).where(F.col("place") <= limit)
    found: dict[int, dict[str, list[int]]] = {}
    totals: dict[int, list[int]] = {}
    at = {lang: i for i, lang in enumerate(langs)}
    # As Arrow, and not a Python object for each row, of which there may be MAX_ENTRIES.
    for batch in top.select("lang", "size", "entry", "n", "total").orderBy("size", "entry", "lang").toArrow().to_batches(max_chunksize=10_000):
        for lang, size, entry, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(size, {}).setdefault(entry, [0] * len(langs))[at[lang]] = n
            totals.setdefault(size, [0] * len(langs))[at[lang]] = total
    return Model(langs, found, totals)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, with all their columns, whose language is told with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    tune(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = crc32_mod("doc_id", 4)
    model = fit(docs.where(fold != 2))
    return identify(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
