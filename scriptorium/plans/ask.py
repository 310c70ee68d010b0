"""Corpus questions: recognise them, read their constraints, and answer them by aggregation.  Parsing is driver-side."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import structure

#: What a question asks for: an intent is known by any of its phrases, a run of whole words; the first intent that fits counts.
PHRASES = {
    "count": ("how many", "number of", "count"),
    "total": ("total", "sum of", "sum"),
    "average": ("average", "mean"),
    "list": ("list all", "list every", "show all", "show every"),
}
LANGUAGES = {"english": "en", "german": "de", "french": "fr", "spanish": "es"}
COMPARISONS = (("more than", ">"), ("over", ">"), ("at least", ">="), ("less than", "<"), ("under", "<"), ("at most", "<="))


@dataclass
class Question:
    intent: str | None
    language: str | None = None
    top: int | None = None
    comparisons: list[tuple[str, float]] = field(default_factory=list)
    label: str | None = None


def parse(query: str) -> Question:
    low = query.lower()
    words = f" {' '.join(re.findall('[a-z0-9]+', low))} "
    intent = next((name for name, phrases in PHRASES.items() if any(f" {p} " in words for p in phrases)), None)
    language = next((code for name, code in LANGUAGES.items() if name in low), None)
    top = re.search(r"\btop\s+(\d+)", low)
    comparisons = [(sign, float(n)) for words, sign in COMPARISONS for n in re.findall(rf"\b{words}\s+(\d+(?:\.\d+)?)", low)]
    comparisons += [(sign, float(n)) for sign, n in re.findall(r"(>=|<=|>|<)\s*(\d+(?:\.\d+)?)", low)]
    label = re.search(r'(?:total|average|sum|mean)\s+(?:of\s+)?"([^"]+)"', query, re.I)
    return Question(intent, language, int(top[1]) if top else None, comparisons, label[1] if label else None)


def is_corpus_question(query: str) -> bool:
    return parse(query).intent is not None


def answer(docs: DataFrame, query: str) -> DataFrame:
    """Counts, listings, and sums or means of labelled numbers; comparisons apply to the length in characters."""
    q = parse(query)
    if q.intent is None:
        raise ValueError("not a question about the corpus")
    if q.language:
        docs = docs.where(F.col("lang") == q.language)
    for sign, n in q.comparisons:
        docs = docs.where(f"n_chars {sign} {n}")
    if q.intent == "count":
        return docs.agg(F.count("*").alias("answer"))
    if q.intent == "list":
        return docs.select("doc_id", "lang", "source").orderBy("doc_id").limit(q.top or 50)
    stats = structure.key_values(docs)
    stats = stats.where(F.lower("label") == q.label.lower()) if q.label else stats
    return stats.select("label", F.col("total" if q.intent == "total" else "mean").alias("answer"))
