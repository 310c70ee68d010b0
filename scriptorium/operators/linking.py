"""Join-shaped operators: entities and their co-occurrence, document links, grounding, sessions, curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..sources.tables import durable, small, table
from . import dedupe
from .ordering import placed

#: Fixed value: what counts as an entity here, a longer capitalised ASCII word.
ENTITY = "[A-Z][a-z]{6,}"


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, entity: distinct per document, lowered."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), F.lower))).alias("entity"))


def cooccurrence(docs: DataFrame, least: int = 2, pattern: str = ENTITY) -> DataFrame:
    """Pairs of entities in the same line, in at least ``least`` lines.

    Both of a pair stand in so many lines themselves, so rarer entities go before lines are paired.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    e = lines.select("doc_id", "line", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(pattern), F.lit(0)), F.lower))).alias("entity"))
    e = durable(e, "line-entities")
    e = durable(e.join(e.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= least), "entity", "left_semi"), "line-entities")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.line") == F.col("b.line")) & (F.col("a.entity") < F.col("b.entity")))
    return pairs.groupBy(F.col("a.entity").alias("entity_a"), F.col("b.entity").alias("entity_b")).agg(F.count("*").alias("n"), F.countDistinct("a.doc_id").alias("docs")).where(F.col("n") >= least)


def overlaps(docs: DataFrame, least: float = 0.15) -> DataFrame:
    """Pairs of documents by the Jaccard overlap of their entities; documents with the same entities are one node."""
    sets = docs.select("doc_id", F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), F.lower))).alias("w")).where(F.size("w") > 0)
    pairs = dedupe.similar_sets(sets, least)
    return pairs.select("doc_a", "doc_b", "shared", F.round("similarity", 6).alias("overlap"))


def shared_and_different(docs: DataFrame) -> DataFrame:
    """Of each two consecutive documents of a source: identifiers both have, and those only one has."""
    ids = docs.select("doc_id", "source", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d{2,}"), F.lit(0))).alias("ids"))
    places = placed(ids, ["source"], ["doc_id"]).select("doc_id", "source", "ids", "place")
    earlier = places.select("source", (F.col("place") + 1).alias("place"), F.col("ids").alias("before"))
    rows = places.join(earlier, ["source", "place"])
    different = F.sort_array(F.concat(F.array_except("ids", "before"), F.array_except("before", "ids")))
    return rows.select("doc_id", F.array_join(F.sort_array(F.array_intersect("ids", "before")), ",").alias("shared"), F.array_join(different, ",").alias("different"))


def neighbours(docs: DataFrame, seeds: DataFrame, window: int = 1) -> DataFrame:
    """Each seed (doc_id, score) expanded by the documents beside it in its source, at a score 0.05 lower for each step away."""
    places = placed(docs.select("doc_id", "source"), ["source"], ["doc_id"]).select("doc_id", "source", F.col("place").alias("pos"))
    near = places.join(seeds.select("doc_id", "score"), "doc_id").select(F.col("doc_id").alias("seed_id"), "source", "score", F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos"))
    found = near.join(places, ["source", "pos"]).where("doc_id <> seed_id")
    return found.select("seed_id", "doc_id", F.round(F.greatest(F.lit(0.0), F.col("score") - 0.05 * F.abs(F.col("pos") - F.col("at"))), 6).alias("score"))


def grounding(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each benchmark item and the best document: share of its words, and of its word triples, that the document holds.

    Documents' triples are held against the hashes of the benchmark's first, so that only shared ones are shuffled.
    """
    q = benchmark.select("item_id", T.words(F.col("text")).alias("w"))
    q = q.select("item_id", F.array_distinct("w").alias("words"), F.array_distinct(T.ngrams(F.col("w"), 3)).alias("triples"))
    d = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    asked = q.select("item_id", F.size("triples").alias("n"), F.explode("triples").alias("g"))
    hits = asked.join(_shared_grams(docs, asked.select("g").distinct(), 3), "g").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("triples"))
    best = hits.withColumn("r", F.row_number().over(W.Window.partitionBy("item_id").orderBy(F.desc("triples"), "doc_id"))).where("r = 1")
    scored = best.join(q.select("item_id", "words"), "item_id").join(d, "doc_id")
    contained = F.size(F.array_intersect("words", F.array_distinct("w"))) / F.size("words")
    return scored.select("item_id", "doc_id", F.round("triples", 6).alias("ngram_overlap"), F.round(contained, 6).alias("containment"), (contained >= 0.4).alias("grounded"))


def _shared_grams(docs: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """doc_id, g: the distinct word n-grams of the documents that are among ``grams`` (column g)."""
    words = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    found = words.select("doc_id", F.explode_outer(T.ngrams(F.col("w"), n)).alias("g")).where("g is not null")
    return found.join(small(grams), "g", "left_semi").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8) -> DataFrame:
    """Documents that share word ``n``-grams with benchmark items, and how many."""
    words = benchmark.select("item_id", T.words(F.col("text")).alias("w"))
    asked = words.select("item_id", F.explode_outer(T.ngrams(F.col("w"), n)).alias("g")).where("g is not null").distinct()
    return _shared_grams(docs, asked.select("g").distinct(), n).join(small(asked), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def numeric_fidelity(docs: DataFrame) -> DataFrame:
    """Share of the numbers in a document's second half that its first half has as well; 1 without numbers."""
    half = (F.length("text") / 2).cast("int")
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    rows = docs.select("doc_id", numbers(F.substring("text", F.lit(1), half)).alias("a"), numbers(F.substring("text", half + 1, F.length("text"))).alias("b"))
    return rows.select("doc_id", F.size("b").alias("numbers"), F.round(F.when(F.size("b") == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / F.size("b")), 6).alias("fidelity"))


def last_turns(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` turns of each conversation, assistants' texts squeezed and cut to 280 characters."""
    rows = turns.withColumn("back", F.row_number().over(W.Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    said = F.when(F.col("role") == "assistant", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 280)).otherwise(F.col("text"))
    return rows.where(F.col("back") <= n).select("conv_id", "turn", "role", F.md5(said).alias("said_md5"))


def session_search(turns: DataFrame, probe: str = "the") -> DataFrame:
    """The first turn of each conversation that holds the probe."""
    hits = turns.where(F.contains(F.lower("text"), F.lit(f" {probe} ")))
    return hits.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.count("*").alias("hits"))


def session_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"), F.md5(F.max_by("text", "turn")).alias("last_md5"))


def salience(turns: DataFrame) -> DataFrame:
    """Entities of a conversation: recent ones and frequent ones count more."""
    e = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("entity"))
    now = F.max("turn").over(W.Window.partitionBy("conv_id"))
    agg = e.withColumn("now", now).groupBy("conv_id", "entity").agg(F.max("turn").alias("last"), F.count("*").alias("n"), F.first("now").alias("now"))
    return agg.select("conv_id", "entity", F.round(0.6 / F.greatest(F.lit(1), F.col("now") - F.col("last") + 1) + 0.4 * F.least(F.col("n") / 5, F.lit(1.0)), 6).alias("salience"))


def balanced(docs: DataFrame, most: int = 30) -> DataFrame:
    """The first ``most`` documents of each source."""
    return docs.withColumn("place", F.row_number().over(W.Window.partitionBy("source").orderBy("doc_id"))).where(F.col("place") <= most).select("source", "doc_id", "place")


def hash_split(docs: DataFrame, percent: int = 10) -> DataFrame:
    """A repeatable split by the id's hash."""
    part = F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return docs.select("doc_id", F.when(part < percent, "eval").otherwise("train").alias("split"))


def feedback_pairs(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant's next one as a chat sample in JSON."""
    w = W.Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"answer": F.lead("text").over(w), "answerer": F.lead("role").over(w)}).where("role = 'user' and answerer = 'assistant'")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.select("conv_id", "turn", F.md5(F.to_json(F.struct(F.array(message("user", "text"), message("assistant", "answer")).alias("messages")))).alias("sample_md5"))


def round_robin(docs: DataFrame, limit: int = 100) -> DataFrame:
    """Texts of 200 characters and more, distinct by content, dealt in turn from the sources until the limit."""
    usable = docs.where(F.length("text") >= 200).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("doc_id", "source")).alias("d")).select("d.doc_id", "d.source")
    turn = F.row_number().over(W.Window.partitionBy("source").orderBy("doc_id"))
    return usable.withColumn("turn", turn).orderBy("turn", "source").limit(limit).select("doc_id", "source", "turn")


def feedback_stats(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Ratings of each language: good, bad, bad with a reason, unrated."""
    rows = docs.select("doc_id", "lang").join(labels, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("bad_toxic"), F.count_if(F.col("quality").isNull()).alias("unrated"))


def paginated(docs: DataFrame, limit: int = 50, offset: int = 100) -> DataFrame:
    """A page of a listing with the total number of rows."""
    total = docs.agg(F.count("*").alias("total"))
    page = docs.select("doc_id", "source", "lang").orderBy("lang", "doc_id").offset(offset).limit(limit)
    return page.join(F.broadcast(total))


def queries() -> dict[str, tuple]:
    on = lambda name, f: lambda spark, d: f(table(spark, d, name))
    two = lambda f, b="benchmark": lambda spark, d: f(table(spark, d, "documents"), table(spark, d, b))
    w = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
    gram = "CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i+{m}], ' ')) ELSE [] END"
    return {
        "entity_cooccurrence": (
            on("documents", cooccurrence),
            f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents), e AS (SELECT DISTINCT doc_id, line, lower(unnest(regexp_extract_all(s, '{ENTITY}'))) AS entity FROM l)
            SELECT a.entity AS entity_a, b.entity AS entity_b, count(*) AS n, count(DISTINCT a.doc_id) AS docs FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.line = b.line AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2""",
        ),
        "doc_entity_overlap": (
            on("documents", overlaps),
            f"""WITH s AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{ENTITY}'), lambda x: lower(x)))) AS w FROM documents), k AS (SELECT min(doc_id) AS id, w, len(w) AS n FROM s WHERE len(w) > 0 GROUP BY w),
            e AS (SELECT id, n, unnest(w) AS x FROM k), c AS (SELECT a.id AS doc_a, b.id AS doc_b, count(*) AS shared, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
            SELECT doc_a, doc_b, shared, round(j, 6) AS overlap FROM c WHERE j >= 0.15""",
        ),
        "shared_and_diff_values": (
            on("documents", shared_and_different),
            r"""WITH i AS (SELECT doc_id, source, list_distinct(regexp_extract_all(text, '\d{2,}')) AS ids FROM documents), b AS (SELECT *, lag(ids) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM i)
            SELECT doc_id, array_to_string(list_sort(list_intersect(ids, before)), ',') AS shared, array_to_string(list_sort(list_concat(list_filter(ids, lambda x: NOT list_contains(before, x)), list_filter(before, lambda x: NOT list_contains(ids, x)))), ',') AS different FROM b WHERE before IS NOT NULL""",
        ),
        "neighbor_expand": (
            lambda spark, d: neighbours(table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", (0.5 + 0.4 * F.col("quality")).alias("score")), 2),
            """WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents)
            SELECT s.doc_id AS seed_id, n.doc_id, round(greatest(0, 0.5::DOUBLE + 0.4::DOUBLE * quality - 0.05::DOUBLE * abs(s.pos - n.pos)), 6) AS score
            FROM p s JOIN labels l ON l.doc_id = s.doc_id JOIN p n ON s.source = n.source AND abs(s.pos - n.pos) BETWEEN 1 AND 2""",
        ),
        "grounding_containment": (
            two(grounding),
            f"""WITH q AS (SELECT item_id, {w} AS w FROM benchmark), q2 AS (SELECT item_id, list_distinct(w) AS words, list_distinct({gram.format(n=3, m=2)}) AS triples FROM q), d AS (SELECT doc_id, {w} AS w FROM documents),
            g AS (SELECT DISTINCT doc_id, unnest({gram.format(n=3, m=2)}) AS g FROM d), e AS (SELECT item_id, len(triples) AS n, unnest(triples) AS g FROM q2),
            h AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(n) AS s FROM e JOIN g USING (g) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM h),
            c AS (SELECT b.item_id, b.doc_id, s, len(list_intersect(words, list_distinct(d.w)))::DOUBLE / len(words) AS c FROM b JOIN q2 USING (item_id) JOIN d ON d.doc_id = b.doc_id WHERE r = 1)
            SELECT item_id, doc_id, round(s, 6) AS ngram_overlap, round(c, 6) AS containment, c >= 0.4 AS grounded FROM c""",
        ),
        "benchmark_contamination_ngrams": (
            two(contamination),
            f"""WITH d AS (SELECT doc_id, {w} AS w FROM documents), q AS (SELECT item_id, {w} AS w FROM benchmark), dg AS (SELECT DISTINCT doc_id, unnest({gram.format(n=8, m=7)}) AS g FROM d), qg AS (SELECT DISTINCT item_id, unnest({gram.format(n=8, m=7)}) AS g FROM q)
            SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN qg USING (g) GROUP BY 1, 2""",
        ),
        "numeric_fidelity": (
            on("documents", numeric_fidelity),
            r"""WITH h AS (SELECT doc_id, list_distinct(regexp_extract_all(substr(text, 1, length(text) // 2), '\d+(?:\.\d+)?')) AS a, list_distinct(regexp_extract_all(substr(text, length(text) // 2 + 1), '\d+(?:\.\d+)?')) AS b FROM documents)
            SELECT doc_id, len(b)::INT AS numbers, round(CASE WHEN len(b) = 0 THEN 1 ELSE len(list_intersect(a, b))::DOUBLE / len(b) END, 6) AS fidelity FROM h""",
        ),
        "last_n_turns": (
            on("conversations", last_turns),
            r"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
            SELECT conv_id, turn, role, md5(CASE WHEN role = 'assistant' THEN substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 280) ELSE text END) AS said_md5 FROM r WHERE back <= 3""",
        ),
        "session_search_first_hit": (on("conversations", session_search), "SELECT conv_id, min(turn) AS turn, count(*) AS hits FROM conversations WHERE contains(lower(text), ' the ') GROUP BY 1"),
        "session_summary_stats": (on("conversations", session_stats), "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn, md5(arg_max(text, turn)) AS last_md5 FROM conversations GROUP BY 1"),
        "entity_salience": (
            on("conversations", salience),
            """WITH e AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS entity FROM conversations), n AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS now FROM e)
            SELECT conv_id, entity, round(0.6::DOUBLE / greatest(1, max(now) - max(turn) + 1) + 0.4::DOUBLE * least(count(*) / 5, 1), 6) AS salience FROM n GROUP BY 1, 2""",
        ),
        "balance_per_category": (on("documents", balanced), "WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place FROM documents) SELECT * FROM r WHERE place <= 30"),
        "hash_split": (on("documents", hash_split), "SELECT doc_id, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 10 THEN 'eval' ELSE 'train' END AS split FROM documents"),
        "feedback_pairs_json": (
            on("conversations", feedback_pairs),
            """WITH p AS (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS answerer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
            SELECT conv_id, turn, md5('{"messages":[{"role":"user","content":' || to_json(text) || '},{"role":"assistant","content":' || to_json(answer) || '}]}') AS sample_md5 FROM p WHERE role = 'user' AND answerer = 'assistant'""",
        ),
        "round_robin_sample": (
            on("documents", round_robin),
            """WITH u AS (SELECT arg_min(source, doc_id) AS source, min(doc_id) AS doc_id FROM documents WHERE length(text) >= 200 GROUP BY sha256(text)), t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS turn FROM u)
            SELECT doc_id, source, turn FROM t ORDER BY turn, source LIMIT 100""",
        ),
        "feedback_stats": (two(feedback_stats, "labels"), "SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS bad_toxic, count(*) FILTER (WHERE quality IS NULL) AS unrated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
        "paginate_with_total": (on("documents", paginated), "SELECT doc_id, source, lang, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY lang, doc_id LIMIT 50 OFFSET 100"),
        "scope_filter": (lambda spark, d: table(spark, d, "documents").where("source = 'src0' and lang in ('en', 'de')").select("doc_id", "source", "lang"), "SELECT doc_id, source, lang FROM documents WHERE source = 'src0' AND lang IN ('en', 'de')"),
    }
