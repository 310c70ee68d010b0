"""Rule-like operators: gates, policies, versions, bundles, greedy deduplication, timelines, rankings, and star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..sources.tables import durable, small, table
from . import dedupe, retrieval
from .ordering import placed

# Word lists and rules.
STOPWORDS = ("the", "and", "for", "that", "with", "this", "from", "are", "was", "have", "not", "der", "die", "das", "und", "que", "les", "des", "los", "las", "por")
POLICY = (
    ("r1", "required", "license", "medium"),
    ("r2", "forbidden", "worthless", "high"),
    ("r3", "forbidden", "stupid", "high"),
    ("r4", "required", "copyright", "low"),
)
NEGATIONS = ("not", "no", "never", "without", "nicht", "kein")


def greedy_kept(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Greedy first-wins deduplication: in id order a row stays unless it is similar to a row that stays.

    ``pairs``: doc_a < doc_b.  Decided in rounds, each a join: a row whose earlier neighbours are all decided is decided.
    """
    edges = durable(pairs.select("doc_a", "doc_b"), "greedy-pairs")
    open_ids, kept = durable(edges.select(F.col("doc_b").alias("id")).distinct(), "greedy-open"), None
    kept = durable(edges.select(F.col("doc_a").alias("id")).distinct().join(open_ids, "id", "left_anti"), "greedy-kept")
    dropped = None
    while not open_ids.isEmpty():
        gone = edges.join(kept, edges["doc_a"] == kept["id"]).select(F.col("doc_b").alias("id")).distinct()
        dropped = durable(gone if dropped is None else dropped.unionByName(gone).distinct(), "greedy-dropped")
        open_ids = durable(open_ids.join(dropped, "id", "left_anti"), "greedy-open")
        waiting = edges.join(open_ids, edges["doc_a"] == open_ids["id"], "left_semi").select(F.col("doc_b").alias("id"))
        fresh = open_ids.join(waiting, "id", "left_anti")
        kept = durable(kept.unionByName(fresh), "greedy-kept")
        open_ids = durable(open_ids.join(kept, "id", "left_anti"), "greedy-open")
    return ids if dropped is None else ids.join(dropped, "id", "left_anti")


def greedy_jaccard(docs: DataFrame, least: float = 0.85) -> DataFrame:
    """Documents that greedy deduplication keeps: of equal word sets the first, of similar ones the first."""
    pairs = dedupe.jaccard_pairs(docs, least)
    sets = docs.select("doc_id", F.sort_array(F.array_distinct(T.words("text"))).alias("w")).where(F.size("w") >= 3)
    firsts = sets.groupBy(F.sha2(F.array_join("w", " "), 256).alias("sha")).agg(F.min("doc_id").alias("id")).select("id")
    return greedy_kept(pairs, firsts).select(F.col("id").alias("doc_id"))


def quality_tiers(rows: DataFrame, by: str, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Of each group only the high-scored rows (0.7) if there are at least eight; else high and medium ones (0.3); else the best three."""
    counts = rows.groupBy(by).agg(F.count_if(F.col(score) >= 0.7).alias("high"), F.count_if(F.col(score) >= 0.3).alias("medium"))
    least = F.when(F.col("high") >= 8, 0.7).when(F.col("medium") > 0, 0.3)
    joined = rows.join(small(counts.select(by, least.alias("least"))), by)
    best = joined.where("least is null").withColumn("r", F.row_number().over(W.Window.partitionBy(by).orderBy(F.desc(score), key))).where("r <= 3")
    return joined.where(F.col(score) >= F.col("least")).select(*rows.columns).unionByName(best.select(*rows.columns))


def domain_gate(rows: DataFrame, by: str, fits: str, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Of each group: if three of its best five rows do not fit the domain, rows that fit stay where there are six of them,
    else the others' scores fall to 60 %."""
    best = rows.withColumn("r", F.row_number().over(W.Window.partitionBy(by).orderBy(F.desc(score), key))).where("r <= 5")
    gated = best.groupBy(by).agg(F.count_if(~F.col(fits)).alias("off")).join(rows.groupBy(by).agg(F.count_if(fits).alias("n_fit")), by)
    gate = F.when(F.col("off") < 3, "open").when(F.col("n_fit") >= 6, "fits only").otherwise("lower")
    joined = rows.join(small(gated.select(by, gate.alias("gate"))), by)
    kept = joined.where((F.col("gate") != "fits only") | F.col(fits))
    return kept.select(key, by, F.round(F.when((F.col("gate") == "lower") & ~F.col(fits), F.col(score) * 0.6).otherwise(F.col(score)), 6).alias("score"))


def key_terms(docs: DataFrame, k: int = 8) -> DataFrame:
    """Most frequent words of three letters and more without stopwords; ties by first position."""
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("pos", "term")).where(~F.col("term").isin(*STOPWORDS))
    counts = words.groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    ranked = counts.withColumn("rank", F.row_number().over(W.Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= k).select("doc_id", "rank", "term", "n")


def key_phrases(docs: DataFrame, k: int = 10) -> DataFrame:
    """The first ``k`` stopword-free bigrams longer than five characters."""
    w = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0)).alias("w"))
    grams = w.select("doc_id", F.posexplode_outer(T.ngrams(F.col("w"), 2)).alias("pos", "gram")).where("gram is not null")
    part = lambda at: F.split("gram", " ")[at]
    good = grams.where((F.length("gram") > 5) & ~part(0).isin(*STOPWORDS) & ~part(1).isin(*STOPWORDS))
    return good.withColumn("place", F.row_number().over(W.Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("place") <= k).select("doc_id", "place", "gram")


def versions(pages: DataFrame) -> DataFrame:
    """Pages with the same normalised stem and another address: each is held against the first of its stem."""
    stem = F.regexp_replace(F.regexp_replace(F.lower("url"), r"^[a-z]+://(www\.|m\.)?", ""), r"[?#].*$|\.html$|/$", "")
    rows = pages.select("page_id", "url", F.regexp_extract(stem, "([^/]+)$", 1).alias("stem")).where(F.length("stem") >= 3)
    first = rows.groupBy("stem").agg(F.min(F.struct("page_id", "url")).alias("f"))
    return rows.join(first, "stem").where("url <> f.url").select("page_id", F.col("f.page_id").alias("version_of"), "stem")


def policy_findings(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """Forbidden phrases that occur and required ones that do not, per document; the rules are few and broadcast."""
    pairs = docs.select("doc_id", F.lower("text").alias("t")).join(F.broadcast(rules))
    found = F.contains("t", "phrase")
    return pairs.where(F.when(F.col("kind") == "forbidden", found).otherwise(~found)).select("doc_id", "rule_id", "kind", "severity")


def legality(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """0.7 of the mean severity, plus 0.05 for each missing phrase up to 0.35; documents without findings get 0.1."""
    weight = F.when(F.col("severity") == "high", 1.0).when(F.col("severity") == "medium", 0.6).otherwise(0.3)
    agg = policy_findings(docs, rules).groupBy("doc_id").agg(F.avg(weight).alias("mean"), F.count_if(F.col("kind") == "required").alias("missing"), F.count("*").alias("findings"))
    score = F.least(F.lit(1.0), 0.7 * F.col("mean") + F.least(F.lit(0.35), 0.05 * F.col("missing")))
    scored = docs.select("doc_id").join(agg, "doc_id", "left").select("doc_id", F.coalesce("findings", F.lit(0)).alias("findings"), F.round(F.coalesce(score, F.lit(0.1)), 6).alias("risk"))
    return scored.select("*", F.when(F.col("risk") >= 0.66, "HIGH").when(F.col("risk") >= 0.33, "MEDIUM").otherwise("LOW").alias("level"))


def negation_conflicts(docs: DataFrame) -> DataFrame:
    """Adjacent sentences of a text that share words while only one of them negates."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    rows = s.select("doc_id", "pos", F.arrays_overlap(F.regexp_extract_all(F.lower("s"), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, NEGATIONS))).alias("neg"), F.array_distinct(F.regexp_extract_all(F.lower("s"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    w = W.Window.partitionBy("doc_id").orderBy("pos")
    pairs = rows.withColumns({"before": F.lag("w").over(w), "was": F.lag("neg").over(w)}).where("before is not null")
    return pairs.groupBy("doc_id").agg(F.count_if((F.col("neg") != F.col("was")) & (F.size(F.array_intersect("w", "before")) >= 2)).alias("conflicts"), F.round(F.avg(T.jaccard(F.col("w"), F.col("before"))), 6).alias("continuity"))


def pattern_entities(docs: DataFrame) -> DataFrame:
    """Addresses, URLs, durations, and phone-like numbers of at least seven digits, counted per kind and normal form."""
    kinds = {"EMAIL": T.EMAIL, "URL": T.URL, "DURATION": r"\b\d+ (?:days|weeks|months|years)\b", "PHONE": r"\+?\d[\d ()-]{5,}\d"}
    found = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("v")) for k, p in kinds.items()))
    rows = docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", F.explode("f.v").alias("v"))
    good = rows.where((F.col("kind") != "PHONE") | (F.length(F.regexp_replace("v", r"\D", "")) >= 7))
    return good.groupBy("kind", F.lower(F.trim("v")).alias("entity")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def line_type_entropy(docs: DataFrame) -> DataFrame:
    """Entropy of the kinds of a document's lines: blank, table, bullet, heading, text."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    kind = F.when(F.trim("s") == "", "blank").when(F.contains("s", F.lit(" | ")), "table").when(F.rlike("s", F.lit(r"^\s*[-*•]\s")), "bullet").when((F.length("s") < 60) & ~F.rlike("s", F.lit(r"[.!?,]\s*$")), "heading").otherwise("text")
    counts = lines.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.Window.partitionBy("doc_id"))
    return counts.withColumn("p", p).groupBy("doc_id").agg(F.count("*").alias("kinds"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def bundles(docs: DataFrame, size: int = 6, step: int = 5, least: int = 3) -> DataFrame:
    """Windows of ``size`` rows of a source stepping by ``step``; shorter than ``least`` are left out."""
    rows = placed(docs.select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", "source", (F.col("place") - 1).alias("pos"))
    last = F.floor(F.col("pos") / step)
    starts = F.filter(F.array(last - 1, last), lambda b: (b >= 0) & (F.col("pos") < b * step + size))
    return rows.select("doc_id", "source", F.explode(starts).alias("bundle")).groupBy("source", "bundle").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where(F.col("n") >= least)


def timelines(events: DataFrame, minutes: int = 20) -> DataFrame:
    """Users whose events, each taken to last ``minutes``, overlap the one before."""
    end = F.lag("ts").over(W.Window.partitionBy("user_id").orderBy("ts", "event_id")) + F.expr(f"interval {minutes} minutes")
    return events.withColumn("over", F.col("ts") < end).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("over").alias("overlapping"), F.coalesce(F.bool_or("over"), F.lit(False)).alias("implausible"))


def ranked_candidates(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers ranked by weighted, scaled criteria: balance, number of orders, value of orders."""
    agg = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("value"))
    rows = customer.join(agg, customer["c_custkey"] == agg["o_custkey"])
    every = W.Window.partitionBy("c_nationkey")
    scale = lambda c: F.when(F.max(c).over(every) == F.min(c).over(every), 1.0).otherwise((F.col(c) - F.min(c).over(every)) / (F.max(c).over(every) - F.min(c).over(every)))
    scored = rows.select("c_custkey", "c_nationkey", F.round(100 * (0.5 * scale("value") + 0.3 * scale("n") + 0.2 * scale("c_acctbal")), 2).alias("score"))
    return scored.withColumn("place", F.rank().over(every.orderBy(F.desc("score")))).where(F.col("place") <= 5)


def revenue_by_nation(customer, orders, lineitem, supplier, nation, region) -> DataFrame:
    """A star join, which is an extension: revenue of domestic sales by nation of a region."""
    n = nation.join(F.broadcast(region.where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = orders.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    sold = lineitem.select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    joined = sold.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    return joined.groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("n"))


def queries() -> dict[str, tuple]:
    on = lambda name, f: lambda spark, d: f(table(spark, d, name))
    rules = lambda spark: spark.createDataFrame(list(POLICY), "rule_id string, kind string, phrase string, severity string")
    with_rules = lambda f: lambda spark, d: f(table(spark, d, "documents"), rules(spark))
    many = lambda f, *names: lambda spark, d: f(*(table(spark, d, n) for n in names))
    stop = list(STOPWORDS)
    score = "round((doc_id * 53 % 97) / 97.0::DOUBLE, 4)"
    policy = "r(rule_id, kind, phrase, severity) AS (VALUES " + ", ".join(map(str, POLICY)) + "), f AS (SELECT doc_id, rule_id, kind, severity FROM documents, r WHERE CASE WHEN kind = 'forbidden' THEN contains(lower(text), phrase) ELSE NOT contains(lower(text), phrase) END)"
    sents = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    ranked = lambda f: lambda spark, d: f(retrieval.candidates(table(spark, d, "documents"), table(spark, d, "benchmark")))
    cd = retrieval.candidates_sql(retrieval.bm25_sql())
    return {
        "greedy_dedupe_jaccard": (on("documents", greedy_jaccard), None),
        "quality_tiers": (
            ranked(lambda r: quality_tiers(r, "item_id").select("item_id", "doc_id", "score")),
            f"WITH {cd}, w AS (SELECT *, count(*) FILTER (WHERE score >= 0.7) OVER p AS high, count(*) FILTER (WHERE score >= 0.3) OVER p AS medium, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM cd WINDOW p AS (PARTITION BY item_id)) SELECT item_id, doc_id, score FROM w WHERE CASE WHEN high >= 8 THEN score >= 0.7 WHEN medium > 0 THEN score >= 0.3 ELSE r <= 3 END",
        ),
        "domain_gate": (
            ranked(lambda r: domain_gate(r.withColumn("fits", F.col("lang") == "en"), "item_id", "fits")),
            f"""WITH {cd}, s AS (SELECT *, lang = 'en' AS fits FROM cd), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s),
            g AS (SELECT *, count(*) FILTER (WHERE r <= 5 AND NOT fits) OVER (PARTITION BY item_id) >= 3 AS gated, count(*) FILTER (WHERE fits) OVER (PARTITION BY item_id) >= 6 AS enough FROM k)
            SELECT doc_id, item_id, round(CASE WHEN gated AND NOT enough AND NOT fits THEN score * 0.6::DOUBLE ELSE score END, 6) AS score FROM g WHERE NOT gated OR NOT enough OR fits""",
        ),
        "key_terms": (
            on("documents", key_terms),
            f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM t),
            c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS f FROM e WHERE NOT list_contains({stop}, term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f)::INT AS rank FROM c)
            SELECT doc_id, rank, term, n FROM r WHERE rank <= 8""",
        ),
        "key_phrases": (
            on("documents", key_phrases),
            f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') AS w FROM documents), e AS (SELECT doc_id, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t),
            r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS place, gram FROM e WHERE length(gram) > 5 AND NOT list_contains({stop}, split_part(gram, ' ', 1)) AND NOT list_contains({stop}, split_part(gram, ' ', 2)))
            SELECT * FROM r WHERE place <= 10""",
        ),
        "version_chain": (
            on("pages", versions),
            r"""WITH s AS (SELECT page_id, url, regexp_extract(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.|m\.)?', ''), '[?#].*$|\.html$|/$', '', 'g'), '([^/]+)$', 1) AS stem FROM pages),
            f AS (SELECT stem, min(page_id) AS version_of, arg_min(url, page_id) AS first FROM s WHERE length(stem) >= 3 GROUP BY 1) SELECT page_id, version_of, stem FROM s JOIN f USING (stem) WHERE url <> first""",
        ),
        "policy_findings": (with_rules(policy_findings), f"WITH {policy} SELECT * FROM f"),
        "legality_score": (
            with_rules(legality),
            f"""WITH {policy}, a AS (SELECT doc_id, avg(CASE severity WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END) AS mean, count(*) FILTER (WHERE kind = 'required') AS missing, count(*) AS findings FROM f GROUP BY 1),
            s AS (SELECT doc_id, coalesce(findings, 0) AS findings, round(coalesce(least(1, 0.7::DOUBLE * mean + least(0.35::DOUBLE, 0.05::DOUBLE * missing)), 0.1::DOUBLE), 6) AS risk FROM documents LEFT JOIN a USING (doc_id))
            SELECT *, CASE WHEN risk >= 0.66 THEN 'HIGH' WHEN risk >= 0.33 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""",
        ),
        "negation_conflicts": (
            on("documents", negation_conflicts),
            rf"""WITH s AS (SELECT doc_id, unnest({sents}) AS x, unnest(range(len({sents}))) AS pos FROM documents),
            w AS (SELECT doc_id, pos, list_has_any(regexp_extract_all(lower(x), '[a-z]+'), {list(NEGATIONS)}) AS neg, list_distinct(regexp_extract_all(lower(x), '[a-z]{{3,}}')) AS w FROM s),
            p AS (SELECT *, lag(w) OVER k AS before, lag(neg) OVER k AS was FROM w WINDOW k AS (PARTITION BY doc_id ORDER BY pos)),
            j AS (SELECT doc_id, neg, was, len(list_intersect(w, before)) AS c, len(w) AS a, len(before) AS b FROM p WHERE before IS NOT NULL)
            SELECT doc_id, count(*) FILTER (WHERE neg <> was AND c >= 2) AS conflicts, round(avg(CASE WHEN a = 0 OR b = 0 THEN 0 ELSE c::DOUBLE / (a + b - c) END), 6) AS continuity FROM j GROUP BY 1""",
        ),
        "pattern_entities": (
            on("documents", pattern_entities),
            r"""WITH f AS (SELECT doc_id, 'EMAIL' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS v FROM documents UNION ALL SELECT doc_id, 'URL', unnest(regexp_extract_all(text, 'https?://[^\s)>\]]+')) FROM documents
            UNION ALL SELECT doc_id, 'DURATION', unnest(regexp_extract_all(text, '\b\d+ (?:days|weeks|months|years)\b')) FROM documents UNION ALL SELECT doc_id, 'PHONE', unnest(regexp_extract_all(text, '\+?\d[\d ()-]{5,}\d')) FROM documents)
            SELECT kind, lower(trim(v)) AS entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM f WHERE kind <> 'PHONE' OR length(regexp_replace(v, '\D', '', 'g')) >= 7 GROUP BY 1, 2""",
        ),
        "line_type_entropy": (
            on("documents", line_type_entropy),
            r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents),
            k AS (SELECT doc_id, CASE WHEN trim(s) = '' THEN 'blank' WHEN contains(s, ' | ') THEN 'table' WHEN regexp_matches(s, '^\s*[-*•]\s') THEN 'bullet' WHEN length(s) < 60 AND NOT regexp_matches(s, '[.!?,]\s*$') THEN 'heading' ELSE 'text' END AS kind, count(*) AS n FROM l GROUP BY 1, 2),
            p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id) AS p FROM k) SELECT doc_id, count(*) AS kinds, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""",
        ),
        "bundle_adjacent": (
            on("documents", bundles),
            """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents), b AS (SELECT source, unnest(range(0, max(pos) // 5 + 1)) AS bundle FROM p GROUP BY source)
            SELECT b.source, bundle, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM b JOIN p ON p.source = b.source AND p.pos >= bundle * 5 AND p.pos < bundle * 5 + 6 GROUP BY 1, 2 HAVING count(*) >= 3""",
        ),
        "timeline_overlaps": (on("events", timelines), "WITH l AS (SELECT *, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 20 MINUTE AS over FROM events) SELECT user_id, count(*) AS n, count(*) FILTER (WHERE over) AS overlapping, coalesce(bool_or(over), false) AS implausible FROM l GROUP BY 1"),
        "ranked_candidates": (
            many(ranked_candidates, "customer", "orders"),
            """WITH a AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS value FROM orders GROUP BY 1), j AS (SELECT c_custkey, c_nationkey, c_acctbal AS b, n, value FROM customer JOIN a ON c_custkey = o_custkey),
            s AS (SELECT c_custkey, c_nationkey, round(100 * (0.5::DOUBLE * CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END
              + 0.3::DOUBLE * CASE WHEN max(n) OVER w = min(n) OVER w THEN 1 ELSE (n - min(n) OVER w)::DOUBLE / (max(n) OVER w - min(n) OVER w) END + 0.2::DOUBLE * CASE WHEN max(b) OVER w = min(b) OVER w THEN 1 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END), 2) AS score FROM j WINDOW w AS (PARTITION BY c_nationkey)),
            r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY score DESC)::INT AS place FROM s) SELECT * FROM r WHERE place <= 5""",
        ),
        "star_revenue_by_nation": (
            many(revenue_by_nation, "customer", "orders", "lineitem", "supplier", "nation", "region"),
            """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""",
        ),
    }
