"""A training corpus from raw documents: five stages, each on all that the one before kept.

``run`` writes each stage as Parquet in the shared folder and reads it again, so that a lost executor costs one stage at
most.  ``ORACLE_SQL`` is None: neither the language model nor BPE can be put in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from scriptorium.llm.common import durable, scratch, table

#: Documents whose language is told with less than this go (an even guess among four languages scores 0.25).
LEAST_LANGUAGE_SCORE = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language is told: null, without letters, or too doubtful.  The labels are those in ``lang``."""
    return language_id.keep_known(docs.select(COLUMNS), language_id.fit(docs), LEAST_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand earlier; a document of which nothing but blanks is left goes."""
    found = line_dedup.dedup_lines(docs.select(COLUMNS), max_words=1, least_equal=1)
    emptied = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s", "")) == "")
    return found.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group (five-word shingles, similarity 0.8 or more).

    Groups are those of the texts given, put together with those that the same documents made before lines were taken
    out of them: of a near-copy only the lines that tell it apart may be left, which are like nothing else.
    """
    return near_dedup.deduplicated(docs.select(COLUMNS), before=table(spark, sf_dir, "documents"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents into which a benchmark item leaked."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every document left."""
    return bpe.bpe_encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
