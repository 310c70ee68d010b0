"""Labels of texts by phrases: one automaton over all phrases, counts by label, and a decision."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

# Phrases that speak for a kind of section, and degrees that decide between kinds.
KINDS = {
    "education": (
        "b.tech", "btech", "b.sc", "bsc", "b.a", "ba", "m.tech", "mtech", "m.sc", "msc", "m.a", "ma", "mba", "phd", "degree", "diploma", "university", "college", "school", "bachelor", "master",
        "graduation", "gpa", "cgpa", "specialization", "major", "minor", "coursework",
    ),
    "certifications": ("certified", "certification", "credential", "certificate", "license", "pmp", "ccna", "rhce", "comptia", "licensed", "accredited", "board", "exam"),
    "identity_contact": ("email:", "phone:", "mobile:", "linkedin.com", "contact info", "contact details", "tel:", "whatsapp:", "github.com/"),
    "achievements": ("award", "achievement", "accomplishment", "recognition", "winner", "best", "excellence", "honor", "distinction", "promoted", "commendation", "merit", "outstanding", "superior"),
    "line_items": ("line item", "unit price", "quantity", "item description", "sku", "product code", "amount", "rate", "hours", "subtotal"),
    "parties_addresses": ("bill to", "ship to", "sold to", "vendor", "supplier", "buyer", "seller", "remit to", "billing address", "shipping address"),
    "terms_conditions": ("payment term", "net 30", "net 60", "due upon receipt", "warranty", "liability", "condition", "late fee", "penalty"),
    "financial_summary": ("subtotal", "grand total", "tax total", "amount due", "balance due", "total amount", "opening balance", "closing balance", "net total", "account summary", "statement summary"),
    "transactions": ("transaction", "debit", "credit", "withdrawal", "deposit", "transfer", "payment", "check number", "reference number"),
    "legal_clauses": ("governing law", "indemnification", "confidentiality", "arbitration", "limitation of liability", "force majeure", "termination", "non-compete", "intellectual property", "dispute resolution"),
    "legal_preamble": ("whereas", "recital", "preamble", "hereby", "hereinafter", "party of the first part", "entered into", "effective date"),
    "legal_definitions": ("shall mean", "defined as", "herein referred", "as used in", "interpretation", "definition"),
    "legal_signatures": ("signature", "witness", "notary", "executed", "authorized signatory", "in witness whereof", "duly authorized"),
    "medical_findings": ("diagnosis", "assessment", "impression", "clinical finding", "chief complaint", "history of present illness", "review of systems", "physical examination", "prognosis"),
    "medical_medications": ("medication", "prescription", "dosage", "drug", "frequency", "route of administration", "pharmacy", "refill"),
    "medical_lab_results": ("lab result", "blood test", "urinalysis", "hemoglobin", "glucose", "cholesterol", "white blood cell", "platelet", "reference range"),
    "medical_patient_info": ("patient name", "date of birth", "medical record number", "mrn", "insurance", "allergies", "emergency contact"),
}
DEGREE = r"\b(?:bachelor|master|phd|doctorate|b\.?tech|m\.?tech|b\.?s|m\.?s|b\.?a|m\.?a|mba|diploma)\b"
#: Phrases of a kind that a text holds at least; what it is otherwise.
LEAST, OTHER = 2, "section_text"


class Phrases:
    """All phrases in one automaton: finding them costs a pass over the text, however many they are."""

    def __init__(self, kinds: Mapping[str, Sequence[str]]):
        import ahocorasick

        of: dict[str, list[int]] = {}
        for k, phrases in enumerate(kinds.values()):
            for phrase in dict.fromkeys(p.lower() for p in phrases if p):
                of.setdefault(phrase, []).append(k)
        self.kinds, self._automaton = list(kinds), ahocorasick.Automaton()
        for n, (phrase, labels) in enumerate(of.items()):
            self._automaton.add_word(phrase, (n, tuple(labels)))
        if of:
            self._automaton.make_automaton()
        self._empty = not of

    def counts(self, text: str) -> tuple[list[int], list[int]]:
        """By kind: how many of its phrases the lowered text holds, and how often in all (overlapping ones too)."""
        present, hits, seen = [0] * len(self.kinds), [0] * len(self.kinds), set()
        for _, (phrase, labels) in () if self._empty else self._automaton.iter(text.lower()):
            fresh = phrase not in seen
            seen.add(phrase)
            for k in labels:
                hits[k] += 1
                present[k] += fresh
        return present, hits


def phrase_counts(docs: DataFrame, kinds: Mapping[str, Sequence[str]] = KINDS, key: str = "doc_id", decides: Mapping[str, str] | None = None) -> DataFrame:
    """key, ``present`` and ``hits`` (arrays by kind), and ``decided`` (kinds whose pattern in ``decides`` the text matches), a row for each row.

    Defined results: null and empty texts hold nothing; case does not matter; phrases may overlap and stand within words.
    """
    kind = dict(docs.dtypes)[key]
    rules = dict(decides or {})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, patterns = Phrases(kinds), {k: re.compile(p, re.IGNORECASE) for k, p in rules.items()}
        for batch in batches:
            present, hits, decided = [], [], []
            for text in batch.column("text").to_pylist():
                p, h = phrases.counts(text or "")
                present.append(p)
                hits.append(h)
                decided.append([k for k, pattern in patterns.items() if pattern.search(text or "")])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(present, pa.list_(pa.int32())), pa.array(hits, pa.list_(pa.int32())), pa.array(decided, pa.list_(pa.string()))], ["key", "present", "hits", "decided"])

    return docs.select(F.col(key).alias("key"), "text").mapInArrow(work, f"key {kind}, present array<int>, hits array<int>, decided array<string>").withColumnRenamed("key", key)


def section_kinds(docs: DataFrame, kinds: Mapping[str, Sequence[str]] = KINDS, least: int = LEAST) -> DataFrame:
    """doc_id, kind, score: the kind most of whose phrases the text holds, if ``least``; of equals education if a degree is named, else the first listed."""
    names = F.array(*map(F.lit, kinds))
    found = phrase_counts(docs, kinds, decides={"education": DEGREE})
    score = F.array_max("present")
    top = F.filter(F.arrays_zip(names.alias("kind"), F.col("present")), lambda x: x["present"] == F.array_max("present"))
    kind = F.when((score >= least) & F.exists(top, lambda x: F.array_contains("decided", x["kind"])), F.element_at(F.filter(top, lambda x: F.array_contains("decided", x["kind"])), 1)["kind"]).when(score >= least, F.element_at(top, 1)["kind"]).otherwise(OTHER)
    return found.select("doc_id", kind.alias("kind"), score.alias("score"))


def kind_statistics(docs: DataFrame) -> DataFrame:
    """source, kind, n_docs, mean_score over a corpus."""
    kinds = section_kinds(docs.select(F.struct("doc_id", "source").alias("doc_id"), "text"))
    return kinds.groupBy(F.col("doc_id.source").alias("source"), "kind").agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 6).alias("mean_score"))


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    scores = ", ".join("(" + " + ".join(f"contains(low, {quoted(p)})::INT" for p in phrases) + ")" for phrases in KINDS.values())
    return rf"""
WITH d AS (SELECT doc_id, source, lower(coalesce(text, '')) AS low FROM documents),
s AS (SELECT *, [{scores}] AS present, [{", ".join(map(quoted, KINDS))}] AS kinds FROM d),
k AS (
  SELECT doc_id, source, list_max(present)::INT AS score,
    CASE WHEN list_max(present) < {LEAST} THEN '{OTHER}' WHEN present[1] = list_max(present) AND regexp_matches(low, '{DEGREE}') THEN 'education' ELSE kinds[list_position(present, list_max(present))] END AS kind
  FROM s)"""


def queries() -> dict[str, tuple]:
    docs = lambda f: lambda spark, d: f(table(spark, d, "documents"))
    return {
        "section_kinds": (docs(section_kinds), f"{_sql()} SELECT doc_id, kind, score FROM k"),
        "kind_statistics": (docs(kind_statistics), f"{_sql()} SELECT source, kind, count(*) AS n_docs, round(avg(score), 6) AS mean_score FROM k GROUP BY ALL"),
    }
