"""Re-ranking of retrieved rows: boosts by query terms and names, blends, votes, and how good a retrieval was.

Each takes ranked rows (item_id, doc_id, score) whose texts the caller joins on as ``query`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..sources.tables import small, table
from . import retrieval

#: Words of a question that carry no content.
STOP = ("what", "is", "are", "the", "a", "an", "of", "for", "in", "how", "do", "does", "can", "about", "from", "with", "tell", "me", "show", "please", "give", "could", "would", "all", "each", "every", "this", "that", "those", "these", "my", "their", "your")
NAME = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"


def with_texts(ranked: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    joined = ranked.join(docs.select("doc_id", "text"), "doc_id")
    return joined.join(small(items.select("item_id", F.col("text").alias("query")), 20_000), "item_id")


def _share(found: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(found) / F.size(of)).otherwise(0.0)


def term_boost(rows: DataFrame, boost: float = 0.15) -> DataFrame:
    """score + boost * share of the query's words (three letters and more) that occur anywhere in the text."""
    words = rows.select("item_id", "doc_id", "score", F.lower("text").alias("low"), F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("terms"))
    hits = F.filter("terms", lambda t: F.contains(F.col("low"), t))
    return words.select("item_id", "doc_id", F.round(F.col("score") + boost * _share(hits, F.col("terms")), 6).alias("score"))


def exact_term_boost(rows: DataFrame, boost: float = 0.08) -> DataFrame:
    """score + boost * share of the query's content words that are whole words of the text; repeats count again."""
    asked = F.filter(F.transform(F.split(F.trim("query"), r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[?,!.]+$", "")), lambda w: ~w.isin(*STOP) & (F.length(w) > 2) & F.rlike(w, F.lit(r"^\w+$")))
    words = rows.select("item_id", "doc_id", "score", asked.alias("asked"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))).alias("w"))
    hits = F.filter("asked", lambda t: F.array_contains("w", t))
    return words.select("item_id", "doc_id", F.round(F.col("score") + boost * _share(hits, F.col("asked")), 6).alias("score"))


def name_boost(rows: DataFrame, boost: float = 0.12) -> DataFrame:
    """score + boost for each name of several words in the query that the text holds, 30 % of it where only some of its words occur."""
    named = rows.select("item_id", "doc_id", "score", F.lower("text").alias("low"), F.transform(F.regexp_extract_all("query", F.lit(NAME), F.lit(1)), F.lower).alias("names"))
    part = lambda name: F.exists(F.split(name, r"\s+"), lambda p: F.contains(F.col("low"), p)) & ~F.forall(F.split(name, r"\s+"), lambda p: F.contains(F.col("low"), p))
    whole = F.size(F.filter("names", lambda n: F.contains(F.col("low"), n)))
    partly = F.size(F.filter("names", lambda n: ~F.contains(F.col("low"), n) & part(n)))
    return named.select("item_id", "doc_id", F.round(F.col("score") + boost * whole + 0.3 * boost * partly, 6).alias("score"))


def reranked(rows: DataFrame, most: int = 15) -> DataFrame:
    """0.7 of the scaled score and 0.3 of the scaled keyword F1 (words of three letters and more), best first."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    sets = rows.select("item_id", "doc_id", "score", words("query").alias("q"), words("text").alias("t"))
    f1 = F.coalesce(F.try_divide(2 * F.size(F.array_intersect("q", "t")), F.size("q") + F.size("t")), F.lit(0.0))
    scaled = sets.select("item_id", "doc_id", "score", f1.alias("f1"))
    blended = scaled.select("item_id", "doc_id", F.round(0.7 * retrieval.minmax("score", "item_id") + 0.3 * retrieval.minmax("f1", "item_id"), 5).alias("score"))
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return blended.withColumn("rank", place).where(F.col("rank") <= most)


def domain_vote(rows: DataFrame, domain: str = "lang", first: int = 10) -> DataFrame:
    """The most frequent domain of the first ten rows, if it has two of them and 30 %; else null."""
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    counts = rows.withColumn("r", place).where(F.col("r") <= first).groupBy("item_id", domain).agg(F.count("*").alias("n"))
    best = counts.groupBy("item_id").agg(F.sum("n").alias("seen"), F.min(F.struct((-F.col("n")).alias("m"), F.col(domain).alias("d"))).alias("best"))
    return best.select("item_id", F.when(-F.col("best.m") >= F.greatest(F.lit(2.0), 0.3 * F.col("seen")), F.col("best.d")).alias("domain"))


def manifest(rows: DataFrame, most: int = 10) -> DataFrame:
    """Language with the largest sum of scores, and the sources in the order in which they first come, ten at the most."""
    votes = rows.groupBy("item_id", "lang").agg(F.sum("score").alias("weight")).groupBy("item_id").agg(F.min(F.struct((-F.round("weight", 6)).alias("w"), "lang")).alias("b"))
    firsts = rows.groupBy("item_id", "source").agg(F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("f")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("f", "source"))).alias("s"))
    return votes.join(firsts, "item_id").select("item_id", F.col("b.lang").alias("language"), F.array_join(F.slice(F.col("s.source"), 1, most), ",").alias("sources"))


def source_diversity(rows: DataFrame, expected: int = 5) -> DataFrame:
    """Different sources of an item's rows against the number expected, at most 1."""
    return rows.groupBy("item_id").agg(F.countDistinct("source").alias("sources"), F.round(F.least(F.lit(1.0), F.countDistinct("source") / expected), 6).alias("diversity"))


def retrieval_quality(rows: DataFrame) -> DataFrame:
    """0.35 of the best five rows' word overlap with the query, 0.35 of their mean score, 0.2 of the lead of the best over
    their mean, 0.1 of the sections among the best eight; low below 0.45, high from 0.75."""
    words = lambda c: F.array_distinct(T.words(F.col(c)))
    sets = rows.select("item_id", "doc_id", "source", "score", words("query").alias("q"), words("text").alias("t"))
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    scored = sets.select("item_id", "source", "score", F.coalesce(F.try_divide(F.size(F.array_intersect("q", "t")), F.size("q")), F.lit(0.0)).alias("overlap"), place.alias("r")).where("r <= 8")
    top = lambda c: F.avg(F.when(F.col("r") <= 5, F.col(c)))
    agg = scored.groupBy("item_id").agg(top("overlap").alias("overlap"), top("score").alias("mean"), F.max("score").alias("best"), (F.countDistinct("source") / F.count("*")).alias("sections"))
    gap = F.coalesce(F.try_divide(F.col("best") - F.col("mean"), F.col("best")), F.lit(0.0))
    value = F.round(T.clamp(0.35 * F.col("overlap") + 0.35 * F.col("mean") + 0.2 * gap + 0.1 * F.col("sections")), 4)
    return agg.select("item_id", value.alias("quality")).select("*", F.when(F.col("quality") < 0.45, "low").when(F.col("quality") >= 0.75, "high").otherwise("medium").alias("level"))


def best_per_criterion(rows: DataFrame, by: str, criteria: list[str]) -> DataFrame:
    """For each criterion the group with the highest value; missing values are 0, ties go to the first name."""
    long = rows.select(by, F.explode(F.create_map(*(x for c in criteria for x in (F.lit(c), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))))).alias("criterion", "value"))
    return long.groupBy("criterion").agg(F.min(F.struct((-F.col("value")).alias("v"), F.col(by).alias("b"))).alias("m")).select("criterion", F.col("m.b").alias("best"), (-F.col("m.v")).alias("value"))


def queries() -> dict[str, tuple]:
    def ranked(f, texts=True):
        def query(spark, d):
            docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
            rows = retrieval.candidates(docs, items)
            return f(with_texts(rows, docs, items) if texts else rows)

        return query

    cd = retrieval.candidates_sql(retrieval.bm25_sql())
    ct = f"{cd}, ct AS (SELECT cd.*, d.text, b.text AS query FROM cd JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))"
    words3 = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]{{3,}}'))"
    share = lambda hits, of: f"CASE WHEN len({of}) > 0 THEN len({hits})::DOUBLE / len({of}) ELSE 0 END"
    stop = ", ".join(f"'{w}'" for w in STOP)
    mm = lambda c: f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1.0::DOUBLE ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"
    return {
        "query_term_boost": (ranked(term_boost), f"WITH {ct}, x AS (SELECT item_id, doc_id, score, lower(text) AS low, {words3('query')} AS terms FROM ct) SELECT item_id, doc_id, round(score + 0.15::DOUBLE * {share('list_filter(terms, lambda t: contains(low, t))', 'terms')}, 6) AS score FROM x"),
        "exact_term_boost": (
            ranked(exact_term_boost),
            rf"""WITH {ct}, x AS (SELECT item_id, doc_id, score, list_filter(list_transform(regexp_split_to_array(trim(query), '\s+'), lambda w: regexp_replace(lower(w), '[?,!.]+$', '')), lambda w: w NOT IN ({stop}) AND length(w) > 2 AND regexp_full_match(w, '\w+')) AS asked, list_distinct(regexp_extract_all(lower(text), '\w+')) AS w FROM ct)
            SELECT item_id, doc_id, round(score + 0.08::DOUBLE * {share('list_filter(asked, lambda t: list_contains(w, t))', 'asked')}, 6) AS score FROM x""",
        ),
        "entity_name_boost": (
            ranked(name_boost),
            rf"""WITH {ct}, x AS (SELECT item_id, doc_id, score, lower(text) AS low, list_transform(regexp_extract_all(query, '{NAME}', 1), lambda n: lower(n)) AS names FROM ct),
            y AS (SELECT item_id, doc_id, score, len(list_filter(names, lambda n: contains(low, n))) AS whole, len(list_filter(names, lambda n: NOT contains(low, n) AND len(list_filter(regexp_split_to_array(n, '\s+'), lambda p: contains(low, p))) BETWEEN 1 AND len(regexp_split_to_array(n, '\s+')) - 1)) AS part FROM x)
            SELECT item_id, doc_id, round(score + 0.12::DOUBLE * whole + 0.3::DOUBLE * 0.12::DOUBLE * part, 6) AS score FROM y""",
        ),
        "reranked": (
            ranked(reranked),
            f"""WITH {ct}, x AS (SELECT item_id, doc_id, score, {words3('query')} AS q, {words3('text')} AS t FROM ct), y AS (SELECT item_id, doc_id, score, 2.0::DOUBLE * len(list_intersect(q, t)) / (len(q) + len(t)) AS f1 FROM x),
            rz AS (SELECT item_id, doc_id, round(0.7::DOUBLE * {mm('score')} + 0.3::DOUBLE * {mm('f1')}, 5) AS score FROM y WINDOW w AS (PARTITION BY item_id)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM rz) SELECT * FROM r WHERE rank <= 15""",
        ),
        "domain_vote": (
            ranked(domain_vote, False),
            f"""WITH {cd}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM cd), dc AS (SELECT item_id, lang, count(*) AS n FROM r WHERE r <= 10 GROUP BY 1, 2),
            b AS (SELECT *, sum(n) OVER (PARTITION BY item_id) AS seen, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, lang) AS p FROM dc) SELECT item_id, CASE WHEN n >= greatest(2, 0.3::DOUBLE * seen) THEN lang END AS domain FROM b WHERE p = 1""",
        ),
        "derived_manifest": (
            ranked(manifest, False),
            f"""WITH {cd}, v AS (SELECT item_id, lang, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(score), 6) DESC, lang) AS p FROM cd GROUP BY item_id, lang),
            sf AS (SELECT item_id, source, max(score) AS s, arg_min(doc_id, -score * 1e12 + doc_id) AS d FROM cd GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, d, source) AS p FROM sf)
            SELECT v.item_id, lang AS language, (SELECT string_agg(source, ',' ORDER BY p) FROM o WHERE o.item_id = v.item_id AND o.p <= 10) AS sources FROM v WHERE p = 1""",
        ),
        "source_diversity": (ranked(source_diversity, False), f"WITH {cd} SELECT item_id, count(DISTINCT source) AS sources, round(least(1, count(DISTINCT source)::DOUBLE / 5), 6) AS diversity FROM cd GROUP BY 1"),
        "retrieval_quality": (
            ranked(retrieval_quality),
            f"""WITH {ct}, x AS (SELECT item_id, doc_id, source, score, list_distinct(regexp_extract_all(lower(query), '[a-z0-9'']+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM ct),
            ra AS (SELECT item_id, avg(CASE WHEN r <= 5 THEN len(list_intersect(q, t))::DOUBLE / len(q) END) AS o, avg(CASE WHEN r <= 5 THEN score END) AS m, max(score) AS b, count(DISTINCT source)::DOUBLE / count(*) AS s FROM x WHERE r <= 8 GROUP BY 1),
            v AS (SELECT item_id, round(greatest(0, least(1, 0.35::DOUBLE * o + 0.35::DOUBLE * m + 0.2::DOUBLE * coalesce((b - m) / nullif(b, 0), 0) + 0.1::DOUBLE * s)), 4) AS quality FROM ra) SELECT *, CASE WHEN quality < 0.45 THEN 'low' WHEN quality >= 0.75 THEN 'high' ELSE 'medium' END AS level FROM v""",
        ),
        "best_per_criterion": (
            lambda s, d: best_per_criterion(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("n_chars"), 4).alias("chars")), "source", ["quality", "toxic", "chars"]),
            """WITH g AS (SELECT source, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(n_chars), 4) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1), u AS (UNPIVOT g ON quality, toxic, chars INTO NAME criterion VALUE value),
            r AS (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY value DESC, source) AS p FROM u) SELECT criterion, source AS best, value FROM r WHERE p = 1""",
        ),
    }
