"""What texts say in forms and in causes, and chunks that would better be one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

# Labels that are none, words that make a label a sentence, markers of causes, those that stand before the cause.
NO_LABELS = ("note", "notes", "example", "e.g", "i.e", "see", "refer", "page", "figure", "table", "section", "chapter")
PROSE = (
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could",
    "please", "ensure", "note", "if", "when", "while", "although", "because", "however", "therefore", "furthermore", "additionally", "moreover",
    "provided", "required", "include", "contains", "describe", "indicate", "specify",
)
CAUSAL = r"(?i)\b(because|caused|resulted?\s+in|led\s+to|due\s+to|as\s+a\s+result|therefore|consequently|triggered|contributing\s+to|arising\s+from|following|attributed\s+to|prompted|induced|since|in\s+response\s+to|as\s+a\s+consequence)\b"
CAUSE_BEHIND = ("because", "due to", "arising from", "attributed to", "contributing to", "following", "in response to", "since")
#: Forms of a field on a line, and how sure each is; a label alone takes the indented line below.
FIELDS = ((r"^(.{2,50}):\s+(\S.*)$", 0.9), (r"^(.{2,50})\t+(\S.*)$", 0.7), (r"^(.{2,50})\s{3,}(\S.*)$", 0.7))
ALONE, INDENTED = r"^(.{2,50}):\s*$", r"^\s+(\S.*)$"


def _is_label(label: Column) -> Column:
    """Whether a lowered label is a field's name rather than prose or a reference."""
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()]+|[.,;:!?"'()]+$""", ""))
    return (F.size(words).between(1, 8)) & ~F.arrays_overlap(plain, F.array(*map(F.lit, PROSE))) & ~label.isin(*NO_LABELS)


def form_fields(docs: DataFrame) -> DataFrame:
    """doc_id, label (lowered), value, confidence, pos (line, from 0) of the fields that lines spell out, each once.

    Fields are ``Label: value``, ``Label<tab>value``, ``Label   value``, and a label with a colon over an indented value.
    Of a line the first form that fits counts; a field named twice keeps its surest and first.  Null texts have none.
    """
    lines = docs.select("doc_id", F.split("text", "\n").alias("lines")).where("lines is not null")
    each = lines.select("doc_id", F.posexplode(F.transform("lines", lambda line, i: F.struct(line.alias("line"), F.get(F.col("lines"), i + 1).alias("below")))).alias("pos", "x")).select("doc_id", "pos", "x.line", "x.below")
    found = F.when(F.rlike("line", F.lit(ALONE)) & F.rlike("below", F.lit(INDENTED)), F.struct(F.regexp_extract("line", ALONE, 1).alias("label"), F.regexp_extract("below", INDENTED, 1).alias("value"), F.lit(0.9).alias("confidence")))
    for pattern, sure in reversed(FIELDS):
        found = F.when(F.rlike("line", F.lit(pattern)), F.struct(F.regexp_extract("line", pattern, 1).alias("label"), F.regexp_extract("line", pattern, 2).alias("value"), F.lit(sure).alias("confidence"))).otherwise(found)
    fields = each.select("doc_id", "pos", found.alias("f")).where("f is not null")
    fields = fields.select("doc_id", "pos", F.lower(T.strip(F.col("f.label"))).alias("label"), T.strip(F.col("f.value")).alias("value"), "f.confidence").where("value <> ''")
    kept = fields.where(_is_label(F.col("label")))
    best = F.min(F.struct((-F.col("confidence")).alias("less"), "pos", "value")).alias("best")
    return kept.groupBy("doc_id", "label", F.lower("value").alias("_value")).agg(best).select("doc_id", "label", "best.value", (-F.col("best.less")).alias("confidence"), "best.pos")


def causal_links(docs: DataFrame, most: int = 5, longest: int = 150) -> DataFrame:
    """doc_id, n, marker, cause, effect: the first ``most`` sentences of a document that name a cause, ``longest`` characters a side.

    The cause stands behind markers like "because" and before those like "led to".  Sentences under 15 characters, and
    those with fewer than five on a side, name none.
    """
    sentences = F.filter(F.transform(F.split("text", r"[.!?\n]+"), T.strip), lambda s: (F.length(s) >= 15) & F.rlike(s, F.lit(CAUSAL)))
    parts = docs.select("doc_id", F.transform(sentences, lambda s: F.struct(s.alias("s"), F.regexp_extract(s, CAUSAL, 1).alias("m"))).alias("found"))

    def sides(x: Column) -> Column:
        before = F.split(x["s"], CAUSAL, 2)[0]
        after = F.substring(x["s"], F.length(before) + F.length(x["m"]) + 1, F.length(x["s"]))
        return F.struct(F.lower(x["m"]).alias("marker"), T.strip(before).alias("before"), T.strip(after).alias("after"))

    whole = parts.select("doc_id", F.filter(F.transform("found", sides), lambda x: (F.length(x["before"]) >= 5) & (F.length(x["after"]) >= 5)).alias("links"))
    each = whole.select("doc_id", F.posexplode(F.slice("links", 1, most)).alias("n", "x"))
    behind = F.col("x.marker").isin(*CAUSE_BEHIND)
    side = lambda c: F.substring(c, 1, longest)
    return each.select("doc_id", (F.col("n") + 1).alias("n"), "x.marker", side(F.when(behind, F.col("x.after")).otherwise(F.col("x.before"))).alias("cause"), side(F.when(behind, F.col("x.before")).otherwise(F.col("x.after"))).alias("effect"))


def recommended_merges(docs: DataFrame, size: int = 40, overlap: int = 34, least: float = 0.7, shortest: int = 200, longest: int = 1500) -> DataFrame:
    """doc_id, chunk_index, similarity: chunks that are like the next one and, together with it, neither too short nor too long.

    Chunks are windows of ``size`` tokens with ``overlap`` shared ones; likeness is the Jaccard similarity of their words
    of three letters and more.  Both chunks come from one row, so nothing is shuffled.
    """
    step = size - overlap
    tokens = docs.select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > size)
    rows = tokens.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.ceil((F.size("w") - size) / step).cast("int") - 1)).alias("chunk_index"))
    chunk = lambda k: F.array_join(F.slice("w", k * step + 1, size), " ")
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.rlike(w, F.lit("^[a-z]{3,}$"))))
    pairs = rows.select("doc_id", "chunk_index", chunk(F.col("chunk_index")).alias("a"), chunk(F.col("chunk_index") + 1).alias("b"))
    pairs = pairs.where((F.length("a") + F.length("b")).between(shortest, longest)).select("doc_id", "chunk_index", words("a").alias("a"), words("b").alias("b")).where("size(a) > 0 and size(b) > 0")
    both = F.size(F.array_intersect("a", "b"))
    alike = pairs.select("doc_id", "chunk_index", F.round(both / (F.size("a") + F.size("b") - both), 6).alias("similarity"))
    return alike.where(F.col("similarity") >= least)


def queries() -> dict[str, tuple]:
    docs = lambda f: lambda spark, d: f(table(spark, d, "documents"))
    strip = lambda e: rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    forms = " ".join(f"WHEN regexp_matches(line, '{p}') THEN {{'label': regexp_extract(line, '{p}', 1), 'value': regexp_extract(line, '{p}', 2), 'sure': {sure}::DOUBLE}}" for p, sure in FIELDS)
    words = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}')))"
    return {
        "form_fields": (
            docs(lambda d: form_fields(d).select("doc_id", "label", F.md5("value").alias("value_md5"), "confidence", "pos")),
            rf"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
            b AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS below FROM l),
            f AS (SELECT doc_id, pos, CASE {forms} WHEN regexp_matches(line, '{ALONE}') AND regexp_matches(below, '{INDENTED}') THEN {{'label': regexp_extract(line, '{ALONE}', 1), 'value': regexp_extract(below, '{INDENTED}', 1), 'sure': 0.9::DOUBLE}} END AS f FROM b),
            n AS (SELECT doc_id, pos, lower({strip('f.label')}) AS label, {strip('f.value')} AS value, f.sure AS sure FROM f WHERE f IS NOT NULL),
            w AS (SELECT *, list_filter(regexp_split_to_array(label, '\s+'), lambda x: x <> '') AS ws FROM n WHERE value <> ''),
            k AS (SELECT * FROM w WHERE len(ws) BETWEEN 1 AND 8 AND label NOT IN ({listed(NO_LABELS)}) AND NOT list_has_any(list_transform(ws, lambda x: regexp_replace(x, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')), [{listed(PROSE)}])),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label, lower(value) ORDER BY sure DESC, pos, value) AS r FROM k)
            SELECT doc_id, label, md5(value) AS value_md5, sure AS confidence, pos FROM r WHERE r = 1""",
        ),
        "causal_links": (
            docs(causal_links),
            rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: {strip('x')}), lambda x: length(x) >= 15 AND regexp_matches(x, '{CAUSAL}')) AS ss FROM documents),
            m AS (SELECT doc_id, list_transform(ss, lambda x: {{'s': x, 'm': regexp_extract(x, '{CAUSAL}', 1)}}) AS ms FROM s),
            p AS (SELECT doc_id, list_filter(list_transform(ms, lambda x: {{'marker': lower(x.m), 'before': {strip(f"regexp_split_to_array(x.s, '{CAUSAL}')[1]")}, 'after': {strip(f"x.s[length(regexp_split_to_array(x.s, '{CAUSAL}')[1]) + length(x.m) + 1 :]")}}}), lambda x: length(x.before) >= 5 AND length(x.after) >= 5)[1 : 5] AS ps FROM m),
            e AS (SELECT doc_id, unnest(range(1, len(ps) + 1))::INT AS n, unnest(ps) AS x FROM p)
            SELECT doc_id, n, x.marker AS marker, CASE WHEN x.marker IN ({listed(CAUSE_BEHIND)}) THEN x.after ELSE x.before END[1 : 150] AS cause, CASE WHEN x.marker IN ({listed(CAUSE_BEHIND)}) THEN x.before ELSE x.after END[1 : 150] AS effect FROM e""",
        ),
        "recommended_merges": (
            docs(recommended_merges),
            rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
            k AS (SELECT doc_id, w, unnest(range(ceil((len(w) - 40) / 6.0)::BIGINT))::INT AS chunk_index FROM t WHERE len(w) > 40),
            p AS (SELECT doc_id, chunk_index, array_to_string(w[chunk_index * 6 + 1 : chunk_index * 6 + 40], ' ') AS a, array_to_string(w[chunk_index * 6 + 7 : chunk_index * 6 + 46], ' ') AS b FROM k),
            s AS (SELECT doc_id, chunk_index, {words.format(c='a')} AS a, {words.format(c='b')} AS b FROM p WHERE length(a) + length(b) BETWEEN 200 AND 1500),
            r AS (SELECT doc_id, chunk_index, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM s WHERE len(a) > 0 AND len(b) > 0)
            SELECT * FROM r WHERE similarity >= 0.7::DOUBLE""",
        ),
    }
