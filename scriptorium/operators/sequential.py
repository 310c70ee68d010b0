"""Order-dependent operators: kernels over single texts or groups that a ranking has bounded.

SQL cannot put these; tests hold the kernels against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from . import kernels, retrieval


def without_similar_lines(docs: DataFrame) -> DataFrame:
    """Lines of each text that repeat or closely resemble one of the ten kept before are dropped; no shuffle."""
    out = docs.select("doc_id", "text").mapInPandas(kernels.line_filter, "doc_id long, n_lines int, n_kept int, kept string")
    return out.select("doc_id", "n_lines", "n_kept", F.md5("kept").alias("kept_md5"))


def evidence(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each item its two best documents by BM25, and how well the closest stretch of each matches the item."""
    pairs = retrieval.bm25(docs, benchmark, 2).join(docs.select("doc_id", F.col("text").alias("hay")), "doc_id").join(benchmark.select("item_id", F.col("text").alias("needle")), "item_id")

    def work(frames):
        for frame in frames:
            frame["ratio"] = [round(kernels.best_window(n, h or ""), 6) for n, h in zip(frame["needle"], frame["hay"], strict=True)]
            yield frame[["item_id", "doc_id", "ratio"]]

    return pairs.select("item_id", "doc_id", "needle", "hay").mapInPandas(work, "item_id long, doc_id long, ratio double")


def contexts(docs: DataFrame, benchmark: DataFrame, budget: int = 1500, most: int = 6) -> DataFrame:
    """Documents that go into an item's context, best first, within a budget of tokens."""
    sizes = docs.select("doc_id", F.size(T.words(F.col("text"))).alias("tokens"))
    ranked = retrieval.bm25(docs, benchmark, 12).join(sizes, "doc_id").select("item_id", "rank", "doc_id", "tokens")
    return ranked.groupBy("item_id").applyInPandas(kernels.budget_picker(budget, most), "item_id long, rank int, doc_id long, tokens int")


def clusters(vectors: DataFrame, least: float = 0.3, most: int = 5) -> DataFrame:
    """The pool of each query's nearest vectors, clustered greedily in order of rank."""
    pool = retrieval.cosine_topk(vectors, 30).join(vectors.select("vec_id", "embedding"), "vec_id")
    return pool.groupBy("query_id").applyInPandas(kernels.cluster_picker(least, most), "query_id long, rank int, vec_id long, cluster int")


def queries() -> dict[str, tuple]:
    on = lambda name, f: lambda spark, d: f(table(spark, d, name))
    two = lambda f: lambda spark, d: f(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return {
        "sequence_matcher_dups": (on("documents", without_similar_lines), None),
        "verify_evidence": (two(evidence), None),
        "context_budget": (two(contexts), None),
        "greedy_clusters": (on("embeddings", clusters), None),
    }
