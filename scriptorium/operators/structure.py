"""Structure of texts: chunks, sections, key-value lines, tables, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..sources.tables import table


def token_windows(docs: DataFrame, size: int = 100, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` blank-separated tokens with ``overlap`` shared ones; the last one ends with the text."""
    step = size - overlap
    tokens = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - size) / step), F.lit(0)).cast("int")
    rows = tokens.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, size)
    return rows.select("doc_id", "chunk_index", F.size(part).alias("n_tokens"), F.md5(F.array_join(part, " ")).alias("chunk_md5"))


def linked_chunks(docs: DataFrame) -> DataFrame:
    """Chunks with stable ids from document, index and content, and the ids before and after."""
    chunks = token_windows(docs).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.sha1(F.concat_ws("|", "doc_id", "chunk_index", "chunk_md5"))))
    w = W.Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.select("doc_id", "chunk_index", "chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), F.count("*").over(W.Window.partitionBy("doc_id")).alias("n_chunks"))


def chunk_overlap(docs: DataFrame) -> DataFrame:
    """How many tokens each chunk repeats from the end of the one before."""
    tokens = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - 60) / 40), F.lit(0)).cast("int")
    chunks = tokens.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("doc_id", "k", F.slice("w", F.col("k") * 40 + 1, 60).alias("part"))
    pairs = chunks.withColumn("before", F.lag("part").over(W.Window.partitionBy("doc_id").orderBy("k"))).where("before is not null")
    return pairs.select("doc_id", F.col("k").alias("chunk_index"), T.overlap_prefix(F.col("before"), F.col("part")).alias("overlap"))


def packed_sentences(docs: DataFrame, most: int = 400) -> DataFrame:
    """Sentences packed greedily, joined by blanks, into chunks of at most ``most`` characters (longer sentences alone)."""
    state = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))

    def step(acc, s):
        size = F.length(s)
        fresh = (acc["used"] > 0) & (acc["used"] + 1 + size > most)
        chunk = F.when(fresh, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = F.when(fresh | (acc["used"] == 0), size).otherwise(acc["used"] + 1 + size)
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.array_append(acc["at"], chunk).alias("at"))

    s = docs.select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    placed = s.select("doc_id", "s", F.aggregate("s", state, step)["at"].alias("at"))
    rows = placed.select("doc_id", F.posexplode(F.arrays_zip("s", "at")).alias("pos", "x")).select("doc_id", "pos", F.col("x.s").alias("sentence"), F.col("x.at").alias("chunk_index"))
    return rows.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n_sentences"), (F.sum(F.length("sentence")) + F.count("*") - 1).alias("n_chars"))


def sections(docs: DataFrame) -> DataFrame:
    """Sections begun by heading-like lines (short, capitalised, without a final mark), numbered by a running count."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", T.strip(F.col("line")).alias("line")).where("line <> ''")
    heading = F.rlike("line", F.lit("^[A-Z]")) & (F.length("line") <= 60) & ~F.rlike("line", F.lit("[.!?,;]$")) & (F.size(F.split("line", r"\s+")) <= 6)
    marked = lines.withColumn("section", F.sum(heading.cast("int")).over(W.Window.partitionBy("doc_id").orderBy("pos")))
    return marked.groupBy("doc_id", "section").agg(F.min("pos").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.md5(F.min_by("line", "pos")).alias("title_md5"))


def key_values(docs: DataFrame) -> DataFrame:
    """Sum, mean and range of every numeric ``Label: value`` line over the corpus."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.NUMERIC_FIELD), F.lit(0))).alias("m"))
    pairs = found.select("doc_id", T.strip(F.split("m", ":")[0]).alias("label"), F.regexp_replace(F.regexp_extract("m", r"([\d,]+\.?\d*)$", 1), ",", "").try_cast("double").alias("value")).where("value is not null")
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("doc_id").alias("docs"))


def contradictions(docs: DataFrame) -> DataFrame:
    """Labels with more than one value in more than one document."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[A-Za-z][A-Za-z ]{1,30}: [^\n]{1,60}$"), F.lit(0))).alias("m"))
    pairs = found.select("doc_id", F.lower(F.split("m", ": ")[0]).alias("label"), F.lower(F.substring_index("m", ": ", -1)).alias("value"))
    return pairs.groupBy("label").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("n_docs")).where("n_values > 1 and n_docs > 1")


def table_cells(docs: DataFrame) -> DataFrame:
    """Cells of lines that are split by bars: rows, widest row, cells, numeric share, and rows of another width than the first."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.contains("line", F.lit(" | ")))
    cells = lines.select("doc_id", "pos", F.transform(F.split("line", r"\|"), T.strip).alias("cells"))
    first = F.first(F.size("cells")).over(W.Window.partitionBy("doc_id").orderBy("pos"))
    rows = cells.select("doc_id", F.size("cells").alias("width"), F.size(F.filter("cells", lambda c: F.rlike(c, F.lit(r"^\d[\d.,]*$")))).alias("numeric"), first.alias("first"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max("width").alias("widest"), F.sum("width").alias("n_cells"), F.sum("numeric").alias("n_numeric"), F.count_if(F.col("width") != F.col("first")).alias("ragged"))


def html_text(pages: DataFrame) -> DataFrame:
    """Title and visible text of pages: scripts, styles, comments and tags dropped, five entities resolved, blanks squeezed."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    plain = F.regexp_replace(body, r"(?s)<[^>]+>", " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(mark))
    clean = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return pages.select("page_id", F.md5(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title_md5"), F.length(clean).alias("n_chars"), F.md5(clean).alias("text_md5"), F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("links"))


def clean_urls(pages: DataFrame) -> DataFrame:
    """URLs without fragments and tracking parameters, and their hosts."""
    bare = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    tidy = F.regexp_replace(F.regexp_replace(bare, r"[?&]+$", ""), r"\?&+", "?")
    return pages.select("page_id", tidy.alias("url"), F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)), r"^www\.", "").alias("host"))


def action_items(docs: DataFrame) -> DataFrame:
    """Distinct sentences with a modal verb, by priority."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).where(F.rlike("sentence", F.lit(r"(?i)\b(must|should|shall|will|need to|required to)\b")))
    first = s.withColumn("seen", F.row_number().over(W.Window.partitionBy("doc_id", F.lower("sentence")).orderBy("pos"))).where("seen = 1")
    priority = F.when(F.rlike("sentence", F.lit(r"(?i)\b(must|shall|required)\b")), "high").when(F.rlike("sentence", F.lit(r"(?i)\bshould\b")), "medium").otherwise("low")
    return first.select("doc_id", "pos", priority.alias("priority"), F.md5("sentence").alias("sentence_md5"))


def queries() -> dict[str, tuple]:
    on = lambda name, f: lambda spark, d: f(table(spark, d, name))
    strip = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"
    sents = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    toks = r"t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)"
    windows = f"""{toks}, k AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 100) / 80.0), 0)::BIGINT + 1))::INT AS chunk_index FROM t WHERE len(w) > 0),
        p AS (SELECT doc_id, chunk_index, w[chunk_index * 80 + 1 : chunk_index * 80 + 100] AS part FROM k),
        win AS (SELECT doc_id, chunk_index, len(part)::INT AS n_tokens, md5(array_to_string(part, ' ')) AS chunk_md5 FROM p)"""
    return {
        "token_windows": (on("documents", token_windows), f"WITH {windows} SELECT * FROM win"),
        "prev_next_links": (
            on("documents", linked_chunks),
            f"""WITH {windows}, i AS (SELECT doc_id, chunk_index, 'chunk_' || sha1(doc_id || '|' || chunk_index || '|' || chunk_md5) AS chunk_id FROM win)
            SELECT doc_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, count(*) OVER (PARTITION BY doc_id) AS n_chunks FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
        ),
        "chunk_overlap_prefix": (
            on("documents", chunk_overlap),
            f"""WITH {toks}, k AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 60) / 40.0), 0)::BIGINT + 1))::INT AS k FROM t WHERE len(w) > 0),
            p AS (SELECT doc_id, k, w[k * 40 + 1 : k * 40 + 60] AS part FROM k), b AS (SELECT *, lag(part) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM p)
            SELECT doc_id, k AS chunk_index, coalesce(list_max(list_filter(range(1, least(len(before), len(part)) + 1), lambda n: before[len(before) - n + 1 : len(before)] = part[1 : n])), 0)::INT AS overlap FROM b WHERE before IS NOT NULL""",
        ),
        "greedy_pack_chunks": (on("documents", packed_sentences), None),
        "section_islands": (
            on("documents", sections),
            rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS s FROM documents), n AS (SELECT doc_id, pos, {strip('s')} AS line FROM l),
            h AS (SELECT *, (regexp_matches(line, '^[A-Z]') AND length(line) <= 60 AND NOT regexp_matches(line, '[.!?,;]$') AND len(regexp_split_to_array(line, '\s+')) <= 6)::INT AS heading FROM n WHERE line <> ''),
            m AS (SELECT *, sum(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
            SELECT doc_id, section::BIGINT AS section, min(pos)::INT AS first_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, md5(arg_min(line, pos)) AS title_md5 FROM m GROUP BY 1, 2""",
        ),
        "numeric_kv_stats": (
            on("documents", key_values),
            rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.NUMERIC_FIELD}')) AS m FROM documents),
            p AS (SELECT doc_id, {strip("split_part(m, ':', 1)")} AS label, try_cast(replace(regexp_extract(m, '([\d,]+\.?\d*)$', 1), ',', '') AS DOUBLE) AS value FROM m)
            SELECT label, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(DISTINCT doc_id) AS docs FROM p WHERE value IS NOT NULL GROUP BY 1""",
        ),
        "contradictions": (
            on("documents", contradictions),
            r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^[A-Za-z][A-Za-z ]{1,30}: [^\n]{1,60}$')) AS m FROM documents)
            SELECT lower(split_part(m, ': ', 1)) AS label, count(DISTINCT lower(split_part(m, ': ', -1))) AS n_values, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1 HAVING count(DISTINCT lower(split_part(m, ': ', -1))) > 1 AND count(DISTINCT doc_id) > 1""",
        ),
        "table_cells": (
            on("documents", table_cells),
            rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS s FROM documents),
            c AS (SELECT doc_id, pos, list_transform(string_split(s, '|'), lambda x: {strip('x')}) AS cells FROM l WHERE contains(s, ' | ')),
            f AS (SELECT *, first_value(len(cells)) OVER (PARTITION BY doc_id ORDER BY pos) AS first FROM c)
            SELECT doc_id, count(*) AS n_rows, max(len(cells))::INT AS widest, sum(len(cells))::BIGINT AS n_cells, sum(len(list_filter(cells, lambda x: regexp_matches(x, '^\d[\d.,]*$'))))::BIGINT AS n_numeric, count(*) FILTER (WHERE len(cells) <> first) AS ragged FROM f GROUP BY 1""",
        ),
        "html_to_text": (
            on("pages", html_text),
            r"""WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS p FROM pages),
            c AS (SELECT page_id, html, trim(regexp_replace(replace(replace(replace(replace(replace(replace(p, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS x FROM t)
            SELECT page_id, md5(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title_md5, length(x)::INT AS n_chars, md5(x) AS text_md5, len(regexp_extract_all(html, '(?i)<a\s'))::INT AS links FROM c""",
        ),
        "url_host_strip_tracking": (
            on("pages", clean_urls),
            r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '\?&+', '?', 'g') AS url,
            regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages""",
        ),
        "action_items": (
            on("documents", action_items),
            rf"""WITH s AS (SELECT doc_id, unnest({sents}) AS x, unnest(range(len({sents}))) AS pos FROM documents),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY pos) AS seen FROM s WHERE regexp_matches(x, '(?i)\b(must|should|shall|will|need to|required to)\b'))
            SELECT doc_id, pos::INT AS pos, CASE WHEN regexp_matches(x, '(?i)\b(must|shall|required)\b') THEN 'high' WHEN regexp_matches(x, '(?i)\bshould\b') THEN 'medium' ELSE 'low' END AS priority, md5(x) AS sentence_md5 FROM r WHERE seen = 1""",
        ),
    }
