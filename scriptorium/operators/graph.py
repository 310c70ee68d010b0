"""Lookups over linked data: entities to sections, neighbours, graph support of retrieved rows, facts and their conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import small, table
from . import linking, retrieval
from .linking import ENTITY


def entities_of(rows: DataFrame, key: str) -> DataFrame:
    """key, entity: distinct within a row, lowered."""
    return rows.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), F.lower))).alias("entity"))


def sections_for_entities(names: DataFrame, mentions: DataFrame, most: int = 20) -> DataFrame:
    """For each key of ``names`` (item_id, entity) the documents that mention one of its entities, those with most first, ``most`` of them."""
    hits = mentions.join(small(names), "entity").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.array_join(F.sort_array(F.collect_list("entity")), ",").alias("entities"))
    place = F.row_number().over(W.Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id"))
    return hits.withColumn("place", place).where(F.col("place") <= most)


def related_entities(names: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected one-hop neighbours of each entity named (column entity), with the weight of the edge."""
    both = edges.select(F.col("entity_a").alias("entity"), F.col("entity_b").alias("related"), "n").unionByName(edges.select(F.col("entity_b").alias("entity"), F.col("entity_a").alias("related"), "n"))
    return both.join(small(names.select("entity").distinct()), "entity", "left_semi")


def within_hops(names: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """entity, related, distance: what lies within ``hops`` edges, at its shortest distance; one join a hop."""
    pairs = edges.select(F.col("entity_a").alias("u"), F.col("entity_b").alias("v"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = names.select("entity", F.col("entity").alias("related"), F.lit(0).alias("distance")).distinct()
    for hop in range(1, hops + 1):
        step = found.where(F.col("distance") == hop - 1).join(both, F.col("related") == F.col("u")).select("entity", F.col("v").alias("related"), F.lit(hop).alias("distance"))
        found = found.unionByName(step).groupBy("entity", "related").agg(F.min("distance").alias("distance"))
    return found.where("distance > 0")


def graph_support(ranked: DataFrame, docs: DataFrame, names: DataFrame, mentions: DataFrame, alpha: float = 0.7) -> DataFrame:
    """alpha * score + (1 - alpha) * support: 1 if the document mentions an entity of the item, half a point if its text
    holds one of the item's entities in any form."""
    linked = mentions.join(small(names), "entity").select("item_id", "doc_id", F.lit(1.0).alias("linked")).distinct()
    terms = names.groupBy("item_id").agg(F.collect_set("entity").alias("terms"))
    rows = ranked.join(linked, ["item_id", "doc_id"], "left").join(small(terms), "item_id", "left").join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id")
    holds = F.when(F.exists(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.col("low"), t)), 0.5).otherwise(0.0)
    support = F.coalesce("linked", F.lit(0.0)) + holds
    return rows.select("item_id", "doc_id", support.alias("support"), F.round(alpha * F.col("score") + (1 - alpha) * support, 6).alias("score"))


def graph_status(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities and mentions of each source, and the edges of the whole graph."""
    found = docs.select("doc_id", "source", "text")
    nodes = found.select("source", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), F.lower))).alias("entity"))
    counts = nodes.groupBy("source").agg(F.count("*").alias("mentions"), F.countDistinct("entity").alias("entities"))
    return counts.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def entity_type_conflicts(mentions: DataFrame) -> DataFrame:
    """entity (lowered), labels in order, n: entities of the mentions (label, entity) that carry more than one label."""
    return mentions.groupBy(F.lower("entity").alias("entity")).agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.countDistinct("label").alias("n")).where("n > 1")


def labelled_mentions(docs: DataFrame, label: str = "lang") -> DataFrame:
    """Mentions with a column of their document as the label."""
    return docs.select(F.col(label).alias("label"), F.explode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("entity"))


def property_facts(events: DataFrame) -> DataFrame:
    """fact_id, subject, predicate, value, confidence: the JSON properties of events as facts about their users.

    The table has no confidences, so the event's own value stands in.
    """
    pairs = events.select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("confidence"), F.explode(F.from_json("props", "map<string,string>")).alias("predicate", "value"))
    return pairs.select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject"), F.upper("predicate").alias("predicate"), F.trim(F.lower("value")).alias("value"), "confidence")


def _different_pairs(facts: DataFrame, value) -> DataFrame:
    """Of each (subject, predicate): facts, different values, and the pairs of facts that differ, counted without making them."""
    counts = facts.withColumn("v", value).where("v is not null").groupBy("subject", "predicate", "v").agg(F.count("*").alias("n"))
    grouped = counts.groupBy("subject", "predicate").agg(F.sum("n").alias("facts"), F.count("*").alias("different"), F.sum(F.col("n") * F.col("n")).alias("alike")).where("different > 1")
    return grouped.select("subject", "predicate", "facts", "different", ((F.col("facts") * F.col("facts") - F.col("alike")) / 2).cast("long").alias("pairs"))


def numeric_conflicts(facts: DataFrame) -> DataFrame:
    """Facts with the same subject and predicate and other numbers; facts without numbers are in no conflict."""
    numbers = F.array_join(F.regexp_extract_all("value", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), ",")
    return _different_pairs(facts, F.nullif(numbers, F.lit("")))


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Facts with the same subject and predicate and another value."""
    return _different_pairs(facts, F.col("value"))


def surest_facts(facts: DataFrame) -> DataFrame:
    """One fact for each (subject, predicate, value): the surest, of equally sure ones the first; no confidence counts as 0."""
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("less"), "fact_id")
    return facts.groupBy("subject", "predicate", "value").agg(F.min_by("fact_id", order).alias("fact_id"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.count("*").alias("n"))


def compared_fields(facts: DataFrame) -> DataFrame:
    """Full comparison: values of a predicate that all its subjects share, and how many only some have."""
    spread = facts.groupBy("predicate", "value").agg(F.countDistinct("subject").alias("subjects"))
    every = facts.groupBy("predicate").agg(F.countDistinct("subject").alias("of"))
    joined = spread.join(small(every), "predicate")
    return joined.groupBy("predicate").agg(F.first("of").alias("subjects"), F.count_if(F.col("subjects") == F.col("of")).alias("shared"), F.count_if(F.col("subjects") < F.col("of")).alias("partial"), F.count_if(F.col("subjects") == 1).alias("unique"))


def queries() -> dict[str, tuple]:
    docs, bench = (lambda s, d: table(s, d, "documents")), (lambda s, d: table(s, d, "benchmark"))
    items = lambda s, d: entities_of(bench(s, d), "item_id")
    seeds = lambda s, d: entities_of(docs(s, d).where("doc_id % 20 = 0"), "doc_id")  # noqa: E731  (the stated query set)
    edges = lambda s, d: linking.cooccurrence(docs(s, d))
    facts = lambda f: lambda s, d: f(property_facts(table(s, d, "events")))
    ents = lambda t, k: f"(SELECT DISTINCT {k}, lower(unnest(regexp_extract_all(text, '{ENTITY}'))) AS entity FROM {t})"
    m, q = f"m AS {ents('documents', 'doc_id')}", f"q AS {ents('benchmark', 'item_id')}"
    seed_sql = f"q AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{ENTITY}'))) AS entity FROM documents WHERE doc_id % 20 = 0)"
    e = f"""l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents),
        le AS (SELECT DISTINCT doc_id, line, lower(unnest(regexp_extract_all(s, '{ENTITY}'))) AS entity FROM l),
        e AS (SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n FROM le a JOIN le b ON a.doc_id = b.doc_id AND a.line = b.line AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2),
        both_ways AS (SELECT entity_a AS u, entity_b AS v, n FROM e UNION ALL SELECT entity_b, entity_a, n FROM e)"""
    f = """k AS (SELECT event_id, user_id, props, coalesce(value, 0) AS confidence, unnest(json_keys(props)) AS p FROM events),
        f AS (SELECT event_id AS fact_id, user_id AS subject, upper(p) AS predicate, trim(lower(json_extract_string(props, '$."' || p || '"'))) AS value, confidence FROM k)"""
    pairs = "c AS (SELECT subject, predicate, v, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY 1, 2, 3) SELECT subject, predicate, sum(n)::BIGINT AS facts, count(*) AS different, ((sum(n) * sum(n) - sum(n * n)) // 2)::BIGINT AS pairs FROM c GROUP BY 1, 2 HAVING count(*) > 1"
    return {
        "sections_for_entities": (
            lambda s, d: sections_for_entities(items(s, d), linking.mentions(docs(s, d))),
            f"WITH {m}, {q}, h AS (SELECT item_id, doc_id, count(*) AS shared, string_agg(entity, ',' ORDER BY entity) AS entities FROM q JOIN m USING (entity) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id)::INT AS place FROM h) SELECT * FROM r WHERE place <= 20",
        ),
        "related_entities": (lambda s, d: related_entities(seeds(s, d), edges(s, d)), f"WITH {seed_sql}, {e} SELECT u AS entity, v AS related, n FROM both_ways WHERE u IN (SELECT entity FROM q)"),
        "entities_within_hops": (
            lambda s, d: within_hops(seeds(s, d), edges(s, d)),
            f"""WITH {seed_sql}, {e}, s0 AS (SELECT DISTINCT entity FROM q), h1 AS (SELECT DISTINCT entity, v AS related, 1 AS distance FROM s0 JOIN both_ways ON u = entity),
            h2 AS (SELECT DISTINCT h1.entity, b.v AS related, 2 AS distance FROM h1 JOIN both_ways b ON b.u = h1.related), a AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
            SELECT entity, related, min(distance)::INT AS distance FROM a WHERE entity <> related GROUP BY 1, 2""",
        ),
        "graph_support": (
            lambda s, d: graph_support(retrieval.candidates(docs(s, d), bench(s, d)), docs(s, d), items(s, d), linking.mentions(docs(s, d))),
            f"""WITH {retrieval.candidates_sql(retrieval.bm25_sql())}, {m}, {q}, x AS (SELECT cd.item_id, cd.doc_id, score, EXISTS (SELECT 1 FROM q JOIN m USING (entity) WHERE q.item_id = cd.item_id AND m.doc_id = cd.doc_id) AS linked,
              EXISTS (SELECT 1 FROM q WHERE q.item_id = cd.item_id AND contains(lower(d.text), q.entity)) AS holds FROM cd JOIN documents d USING (doc_id)),
            y AS (SELECT item_id, doc_id, score, CASE WHEN linked THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN holds THEN 0.5::DOUBLE ELSE 0 END AS support FROM x)
            SELECT item_id, doc_id, support, round(0.7::DOUBLE * score + 0.3::DOUBLE * support, 6) AS score FROM y""",
        ),
        "graph_status": (lambda s, d: graph_status(docs(s, d), edges(s, d)), f"WITH {e}, n AS (SELECT DISTINCT doc_id, source, lower(unnest(regexp_extract_all(text, '{ENTITY}'))) AS entity FROM documents) SELECT source, count(*) AS mentions, count(DISTINCT entity) AS entities, (SELECT count(*) FROM e) AS edges FROM n GROUP BY 1"),
        "entity_type_conflicts": (lambda s, d: entity_type_conflicts(labelled_mentions(docs(s, d))), f"WITH n AS (SELECT lang, lower(unnest(regexp_extract_all(text, '{ENTITY}'))) AS entity FROM documents) SELECT entity, string_agg(DISTINCT lang, ',' ORDER BY lang) AS labels, count(DISTINCT lang) AS n FROM n GROUP BY 1 HAVING count(DISTINCT lang) > 1"),
        "numeric_conflicts": (facts(numeric_conflicts), rf"WITH {f}, w AS (SELECT subject, predicate, nullif(array_to_string(regexp_extract_all(value, '\d+(?:\.\d+)?'), ','), '') AS v FROM f), {pairs}"),
        "duplicate_facts": (facts(duplicate_facts), f"WITH {f}, w AS (SELECT subject, predicate, value AS v FROM f), {pairs}"),
        "first_facts": (facts(surest_facts), f"WITH {f} SELECT subject, predicate, value, arg_min(fact_id, {{'a': -confidence, 'b': fact_id}}) AS fact_id, max(confidence) AS confidence, count(*) AS n FROM f GROUP BY 1, 2, 3"),
        "compared_fields": (
            facts(compared_fields),
            f"""WITH {f}, s AS (SELECT predicate, value, count(DISTINCT subject) AS subjects FROM f GROUP BY 1, 2), v AS (SELECT predicate, count(DISTINCT subject) AS total FROM f GROUP BY 1)
            SELECT predicate, any_value(total) AS subjects, count(*) FILTER (WHERE subjects = total) AS shared, count(*) FILTER (WHERE subjects < total) AS partial, count(*) FILTER (WHERE subjects = 1) AS "unique" FROM s JOIN v USING (predicate) GROUP BY 1""",
        ),
    }
