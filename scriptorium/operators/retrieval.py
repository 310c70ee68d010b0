"""Retrieval: exact vector search, lexical scores, fusion, diversity and evaluation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..sources.tables import durable, small, table
from . import dedupe, kernels, search

text = "text"

#: Terms are bounded by so many buckets.
BUCKETS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _top(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def cosine_topk(vectors: DataFrame, k: int = 5, every: int = 100) -> DataFrame:
    """The ``k`` nearest by cosine of each vector whose id is divisible by ``every``: the stated queries."""
    rows = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = search.nearest_vectors(rows, queries, k, 5).withColumn("score", F.round("score", 5))
    return _top(found, "query_id", k, F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", "score")


def similar_bundles(vectors: DataFrame, least: float = 0.6, k: int = 2, every: int = 100) -> DataFrame:
    """Up to ``k`` neighbours of each seed with a cosine of at least ``least``."""
    return cosine_topk(vectors, k, every).where(F.col("score") >= least)


def centroids(vectors: DataFrame) -> DataFrame:
    """Cosine between the mean vectors of each two labels."""
    parts = vectors.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    a, b = parts.alias("a"), parts.alias("b")
    pairs = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.label") < F.col("b.label"))).groupBy(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))
    sums = pairs.agg(F.sum(F.col("a.x") * F.col("b.x")).alias("ab"), F.sum(F.col("a.x") * F.col("a.x")).alias("aa"), F.sum(F.col("b.x") * F.col("b.x")).alias("bb"))
    strength = F.round(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb")), 5)
    return sums.select("label_a", "label_b", strength.alias("strength"), F.when(strength > 0.7, "similar").when(strength > 0.4, "complementary").otherwise("unrelated").alias("kind"))


def _term_counts(docs: DataFrame) -> DataFrame:
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))).alias("term"))
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def df_bounds(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest df of the terms in each of a fixed number of buckets."""
    found = df.groupBy(F.pmod(F.crc32("term"), F.lit(BUCKETS)).alias("bucket")).agg(F.min("df").alias("low"), F.max("df").alias("high")).toArrow()
    bounds = np.zeros((2, BUCKETS), np.int64)
    for k, name in enumerate(("low", "high")):
        bounds[k, found["bucket"].to_numpy()] = found[name].to_numpy()
    return bounds[0], bounds[1]


def likely_terms(batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """doc_id, term, tf, length of the terms of each row (doc_id, tokens) that may be among its top ``k``.

    A term's bucket bounds its df and so its weight; out are only those that can't reach what ``k`` terms have at least.
    """
    for batch in batches:
        lists = batch.column("tokens")
        words, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        buckets = np.array([zlib.crc32(w) % len(low) for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)
        least, most = (np.log((1 + total) / (1 + x[buckets])) + 1 for x in (high, low))
        codes, rows, terms, tfs, lengths = words.indices.to_numpy(), [], [], [], []
        for row, (start, end) in enumerate(pairwise((ends - ends[0]).tolist())):
            term, tf = np.unique(codes[start:end], return_counts=True)
            if len(term) > k:
                floor = np.partition(tf * least[term], -k)[-k]
                may = tf * most[term] >= floor * (1 - 1e-9) - 2e-8 * (end - start)  # weights are rounded to eight places
                term, tf = term[may], tf[may]
            rows.append(np.full(len(term), row))
            terms.append(term)
            tfs.append(tf)
            lengths.append(np.full(len(term), end - start))
        rows, terms, tfs, lengths = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (rows, terms, tfs, lengths))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), words.dictionary.take(pa.array(terms)), pa.array(tfs), pa.array(lengths)], ["doc_id", "term", "tf", "length"])


def tfidf_top_terms(docs: DataFrame, k: int = 5) -> DataFrame:
    """Top terms of each document by tf / length * (ln((1 + N) / (1 + df)) + 1).

    All terms are counted, but only those that bounds of their df leave among the likely ones are shuffled with their
    documents and get their exact weight.
    """
    tokens = docs.select("doc_id", F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    tokens = dedupe.one_row_each(tokens)
    df = durable(tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term-df")
    total = docs.agg(F.count("*").alias("total"))
    low, high = df_bounds(df)
    shared = docs.sparkSession.sparkContext.broadcast((low, high, total.first()["total"]))
    kernel = lambda batches: likely_terms(batches, *shared.value, k)
    likely = tokens.mapInArrow(kernel, f"doc_id {dict(docs.dtypes)['doc_id']}, term string, tf long, length long")
    scored = likely.join(df, "term").join(F.broadcast(total)).select("doc_id", "term", F.round(F.col("tf") / F.col("length") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1), 8).alias("weight"))
    return _top(scored, "doc_id", k, F.desc("weight"), "term").select("doc_id", "rank", "term", "weight")


def bm25(docs: DataFrame, benchmark: DataFrame, k: int = 5) -> DataFrame:
    """Top documents of each benchmark item: rank, score (k1 1.5, b 0.75)."""
    found = search.top_documents(docs, benchmark, "[a-z0-9]{2,}", k, 5, bm25=True).withColumn("score", F.round("score", 5))
    return _top(found, "item_id", k, F.desc("score"), "doc_id").select("item_id", "rank", "doc_id", "score")


def keyword_f1(docs: DataFrame, benchmark: DataFrame, k: int = 5) -> DataFrame:
    """Set F1 of words of three and more characters."""
    found = search.top_documents(docs, benchmark, "[a-z0-9]{3,}", k, 6, bm25=False).select("item_id", "doc_id", F.round("score", 6).alias("f1"))
    return _top(found, "item_id", k, F.desc("f1"), "doc_id").select("item_id", "rank", "doc_id", "f1")


def minmax(column: str, by: str) -> Column:
    """Scaled to 0 ... 1 within the group; a constant group is all ones."""
    w = W.Window.partitionBy(by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low))


def hybrid(docs: DataFrame, benchmark: DataFrame, alpha: float = 0.6) -> DataFrame:
    """BM25 candidates blended with keyword F1 after min-max scaling."""
    both = bm25(docs, benchmark, 20).select("item_id", "doc_id", F.col("score").alias("lexical")).join(keyword_f1(docs, benchmark, 20).select("item_id", "doc_id", "f1"), ["item_id", "doc_id"])
    scored = both.select("item_id", "doc_id", F.round(alpha * minmax("f1", "item_id") + (1 - alpha) * minmax("lexical", "item_id"), 5).alias("score"))
    return _top(scored, "item_id", 5, F.desc("score"), "doc_id").select("item_id", "rank", "doc_id", "score")


def rrf(lists: list[DataFrame], key: str, by: str, k: int = 60, top: int = 20, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (columns by, key, rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [df.select(by, key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in zip(lists, weights, strict=True)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy(by, key).agg(F.round(F.sum("part"), 8).alias("score"), F.count("*").alias("lists"))
    return _top(fused, by, top, F.desc("score"), key).select(by, "rank", key, "score", "lists")


def candidates(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """The best documents of each item with their source, language, and BM25 score scaled to 0 ... 1 within the item."""
    ranked = bm25(docs, benchmark, k).withColumn("score", F.round(minmax("score", "item_id"), 4))
    found = ranked.select("item_id", "doc_id", "score").join(docs.select("doc_id", "source", "lang"), "doc_id")
    return durable(found, "candidates")  # few rows, and whoever filters them reads them more than once


def adaptive_filter(rows: DataFrame, by: str, key: str = "doc_id", score: str = "score", least: float = 0.3, floor: int = 6) -> DataFrame:
    """Of each group: rows at or above ``least``, or the best ``floor`` if there are fewer of those."""
    good = rows.groupBy(by).agg(F.count_if(F.col(score) >= least).alias("good"))
    ranked = rows.join(small(good), by)
    enough = ranked.where((F.col("good") >= floor) & (F.col(score) >= least))
    few = _top(ranked.where(F.col("good") < floor), by, floor, F.desc(score), key).drop("rank")
    return enough.unionByName(few).select(*rows.columns)


def diversity(rows: DataFrame, section: list[str], key: str = "doc_id", score: str = "score", penalty: float = 0.15) -> DataFrame:
    """Every further row of a section already seen loses a share of its score; the order stays."""
    first = rows.groupBy(*section).agg(F.max_by(key, F.struct(score, -F.col(key))).alias("_first"))
    marked = rows.join(first, section)
    return marked.withColumn(score, F.round(F.when(F.col(key) == F.col("_first"), F.col(score)).otherwise(F.col(score) * (1 - penalty)), 6)).select(*rows.columns)


def confidence(rows: DataFrame, by: str, source: str = "source", key: str = "doc_id", score: str = "score") -> DataFrame:
    """Half the best score, a quarter of its lead over the mean of the best five, a quarter of source coverage."""
    ranked = _top(rows, by, 5, F.desc(score), key)
    agg = ranked.groupBy(by).agg(F.max(score).alias("best"), F.avg(score).alias("mean"), F.countDistinct(source).alias("sources"))
    return agg.select(by, F.round(T.clamp(0.5 * F.col("best") + 0.25 * (F.col("best") - F.col("mean")) + 0.25 * F.least(F.lit(1.0), F.col("sources") / 5)), 4).alias("confidence"))


def mrr(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Mean reciprocal rank (top 10) and precision at 1 of BM25.

    A document is right that holds at least half of the item's different runs of eight words; of an item with fewer words,
    every word.
    """
    hits = bm25(docs, benchmark, 10)
    words = lambda c: T.words(F.col(c))
    texts = hits.join(docs.select("doc_id", words("text").alias("d")), "doc_id").join(benchmark.select("item_id", words("text").alias("i")), "item_id")
    runs = texts.select("item_id", "rank", "d", "i", F.array_distinct(T.ngrams(F.col("i"), 8)).alias("wanted"), T.ngrams(F.col("d"), 8).alias("held"))
    right = F.when(F.size("i") >= 8, F.size(F.array_intersect("wanted", "held")) >= 0.5 * F.size("wanted")).otherwise(F.size(F.array_except("i", "d")) == 0)
    judged = runs.select("item_id", "rank", right.alias("right"))
    best = judged.groupBy("item_id").agg(F.min(F.when(F.col("right"), F.col("rank"))).alias("first"))
    return best.agg(F.count("*").alias("items"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)), 6).alias("p_at_1"))


def mmr_bundles(vectors: DataFrame, k: int = 4, pool: int = 20, balance: float = 0.5, every: int = 100) -> DataFrame:
    """A diverse bundle of each query's nearest vectors; the pool of a query is bounded."""
    near = cosine_topk(vectors, pool, every).join(vectors.select("vec_id", "embedding"), "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    return near.groupBy("query_id").applyInPandas(kernels.mmr_picker(k, balance), "query_id long, pos int, vec_id long")


def hashed_vectors(docs: DataFrame, width: int = 64) -> DataFrame:
    """Hashing vectoriser: index and count of each document's hashed terms."""
    index = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")
    return _term_counts(docs).groupBy("doc_id", index.alias("slot")).agg(F.sum("tf").alias("n"))




def bm25_sql() -> str:
    """SQL of ``bm``: item_id, rank, doc_id and score of every document that shares a term."""
    terms = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)"
    return f"""{terms}, z AS (SELECT doc_id, sum(tf) AS size FROM c GROUP BY 1), st AS (SELECT count(*) AS total, avg(size) AS mean FROM z),
        a AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS term FROM benchmark),
        bs AS (SELECT item_id, doc_id, round(sum(ln(1 + (total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 5) AS score
               FROM c JOIN a USING (term) JOIN f USING (term) JOIN z USING (doc_id), st GROUP BY 1, 2),
        bm AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM bs)"""


def candidates_sql(bm: str) -> str:
    """SQL of ``cd``: what ``candidates`` gives."""
    scaled = "CASE WHEN max(b.score) OVER w = min(b.score) OVER w THEN 1.0::DOUBLE ELSE (b.score - min(b.score) OVER w) / (max(b.score) OVER w - min(b.score) OVER w) END"
    return f"{bm}, cd AS (SELECT b.item_id, b.doc_id, d.source, d.lang, round({scaled}, 4) AS score FROM (SELECT * FROM bm WHERE rank <= 20) b JOIN documents d USING (doc_id) WINDOW w AS (PARTITION BY b.item_id))"


def queries() -> dict[str, tuple]:
    on = lambda name, f: lambda spark, d: f(table(spark, d, name))
    two = lambda f: lambda spark, d: f(table(spark, d, "documents"), table(spark, d, "benchmark"))
    cos = "round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 5)"
    nearest = f"v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, {cos} AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)"
    terms = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)"
    bm = bm25_sql()
    f1 = """dw AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM documents), qw AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS w FROM benchmark),
        de AS (SELECT doc_id, len(w) AS n, unnest(w) AS x FROM dw), qe AS (SELECT item_id, len(w) AS m, unnest(w) AS x FROM qw),
        fs AS (SELECT item_id, doc_id, round(2.0::DOUBLE * count(*) / (any_value(n) + any_value(m)), 6) AS f1 FROM de JOIN qe USING (x) GROUP BY 1, 2),
        ff AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY f1 DESC, doc_id)::INT AS rank, doc_id, f1 FROM fs)"""
    ranked = lambda f: two(lambda d, b: f(candidates(d, b)))
    return {
        "cosine_topk": (on("embeddings", cosine_topk), f"WITH {nearest} SELECT * FROM r WHERE rank <= 5"),
        "knn_min_sim": (on("embeddings", similar_bundles), f"WITH {nearest} SELECT * FROM r WHERE rank <= 2 AND score >= 0.6"),
        "centroid_relations": (
            on("embeddings", centroids),
            """WITH e AS (SELECT label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM e GROUP BY 1, 2),
            p AS (SELECT a.label AS label_a, b.label AS label_b, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 5) AS strength FROM m a JOIN m b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2)
            SELECT *, CASE WHEN strength > 0.7 THEN 'similar' WHEN strength > 0.4 THEN 'complementary' ELSE 'unrelated' END AS kind FROM p""",
        ),
        "tfidf_top_terms": (
            on("documents", tfidf_top_terms),
            f"""WITH {terms}, w AS (SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1), 8) AS weight FROM c JOIN f USING (term)),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS rank FROM w) SELECT doc_id, rank, term, weight FROM r WHERE rank <= 5""",
        ),
        "bm25_topk": (two(bm25), f"WITH {bm} SELECT * FROM bm WHERE rank <= 5"),
        "keyword_f1": (two(keyword_f1), f"WITH {f1} SELECT * FROM ff WHERE rank <= 5"),
        "minmax_hybrid": (
            two(hybrid),
            f"""WITH {bm}, {f1}, j AS (SELECT item_id, doc_id, score, f1 FROM bm JOIN ff USING (item_id, doc_id) WHERE bm.rank <= 20 AND ff.rank <= 20),
            m AS (SELECT *, min(score) OVER w AS sl, max(score) OVER w AS sh, min(f1) OVER w AS fl, max(f1) OVER w AS fh FROM j WINDOW w AS (PARTITION BY item_id)),
            s AS (SELECT item_id, doc_id, round(0.6::DOUBLE * CASE WHEN fh = fl THEN 1 ELSE (f1 - fl) / (fh - fl) END + 0.4::DOUBLE * CASE WHEN sh = sl THEN 1 ELSE (score - sl) / (sh - sl) END, 5) AS score FROM m),
            r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s) SELECT * FROM r WHERE rank <= 5""",
        ),
        "rrf_fuse": (
            two(lambda d, b: rrf([bm25(d, b, 10), keyword_f1(d, b, 10)], "doc_id", "item_id")),
            f"""WITH {bm}, {f1}, u AS (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM bm WHERE rank <= 10 UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM ff WHERE rank <= 10),
            g AS (SELECT item_id, doc_id, round(sum(part), 8) AS score, count(*) AS lists FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM g)
            SELECT item_id, rank, doc_id, score, lists FROM r WHERE rank <= 20""",
        ),
        "adaptive_score_filter": (ranked(lambda r: adaptive_filter(r, "item_id").select("item_id", "doc_id", "score")), f"WITH {candidates_sql(bm)}, w AS (SELECT *, count(*) FILTER (WHERE score >= 0.3) OVER (PARTITION BY item_id) AS good, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM cd) SELECT item_id, doc_id, score FROM w WHERE CASE WHEN good >= 6 THEN score >= 0.3 ELSE rank <= 6 END"),
        "section_diversity": (ranked(lambda r: diversity(r, ["item_id", "source"]).select("item_id", "doc_id", "score")), f"WITH {candidates_sql(bm)}, w AS (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS seen FROM cd) SELECT item_id, doc_id, round(CASE WHEN seen > 1 THEN score * 0.85::DOUBLE ELSE score END, 6) AS score FROM w"),
        "retrieval_confidence": (ranked(lambda r: confidence(r, "item_id")), f"WITH {candidates_sql(bm)}, w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM cd) SELECT item_id, round(greatest(0, least(1, 0.5::DOUBLE * max(score) + 0.25::DOUBLE * (max(score) - avg(score)) + 0.25::DOUBLE * least(1, count(DISTINCT source) / 5))), 4) AS confidence FROM w WHERE r <= 5 GROUP BY 1"),
        "mrr": (
            two(mrr),
            f"""WITH {bm}, w AS (SELECT h.item_id, h.rank, regexp_extract_all(lower(d.text), '[a-z0-9'']+') AS d, regexp_extract_all(lower(q.text), '[a-z0-9'']+') AS i FROM bm h JOIN documents d USING (doc_id) JOIN benchmark q ON q.item_id = h.item_id WHERE rank <= 10),
            g AS (SELECT item_id, rank, d, i, list_distinct(list_transform(range(1, len(i) - 6), lambda k: array_to_string(i[k : k + 7], ' '))) AS wanted, list_transform(range(1, len(d) - 6), lambda k: array_to_string(d[k : k + 7], ' ')) AS held FROM w),
            j AS (SELECT item_id, min(rank) FILTER (WHERE CASE WHEN len(i) >= 8 THEN len(list_intersect(wanted, held)) >= 0.5 * len(wanted) ELSE list_has_all(d, i) END) AS first FROM g GROUP BY 1)
            SELECT count(*) AS items, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(CASE WHEN first = 1 THEN 1 ELSE 0 END), 6) AS p_at_1 FROM j""",
        ),
        "hashed_vectors": (on("documents", hashed_vectors), f"WITH {terms} SELECT doc_id, (('0x' || substr(md5(term), 1, 8))::BIGINT % 64)::INT AS slot, sum(tf)::BIGINT AS n FROM c GROUP BY 1, 2"),
        "mmr_bundles": (on("embeddings", mmr_bundles), None),
    }
