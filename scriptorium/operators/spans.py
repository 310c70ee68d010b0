"""Mentions with positions, what stands near them, and spans of time.

A span table has a row a mention: document, sentence, start, end, label.  Pairs come from a join in bands: the later span
begins within a bounded distance of the earlier one's end, so a long line costs as many pairs as its bands hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table
from .ordering import running

# What mentions look like, by label, and the verbs that tell how two are related.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
LABELS = {
    "ORG": r"[A-Z][A-Za-z]+ (?:Inc|LLC|Ltd|Corp|PLC|GmbH|University|Institute|Group)\b",
    "AMOUNT": r"[$€£] ?[0-9][0-9,]*(?:\.[0-9]+)?",
    "DATE": rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|{MONTH} [0-9]{{4}}",
    "DURATION": r"[0-9]+ (?:years|months|weeks|days)\b",
    "PERSON": r"[A-Z][a-z]+ [A-Z][a-z]+",
}
WORKED_AT = r"\b(?:work(?:s|ed|ing)?|join(?:s|ed|ing)?|manag(?:es|ed|ing)?|employ(?:s|ed|ing)?|lead(?:s|ing)?|led|head(?:s|ed|ing)?|serv(?:es|ed|ing)?|serv(?:ing)?)\b"
STUDIED_AT = r"\b(?:studi(?:es|ed|ing)?|graduat(?:es|ed|ing)?|attend(?:s|ed|ing)?|enroll(?:s|ed|ing)?|complet(?:es|ed|ing)?)\b"
OWES_TO = r"\b(?:ow(?:es|ed|ing)?|due|pay(?:s|ing)?|paid|invoic(?:es|ed|ing)?|bill(?:s|ed|ing)?)\b"
#: Characters between two mentions that are related; what an open end counts as, by type.
BAND = 120
OPEN_END = {"date": "9999-12-31", "timestamp": "9999-12-31", "timestamp_ntz": "9999-12-31", "int": 2**31 - 1, "bigint": 2**63 - 1, "double": float("inf")}
SPANS = "doc_id long, copy long, sentence int, start int, end int, label string, mention string, worked boolean, studied boolean, owes boolean"


def mention_spans(docs: DataFrame, labels: dict[str, str] = LABELS) -> DataFrame:
    """doc_id, copy (a hash of the text), sentence, start, end, label, mention, and which verbs the sentence has.

    Positions are characters within the sentence.  Mentions do not overlap; where two labels begin at one place, the one
    listed first stands.  Rows that repeat a document's text count once; null texts have no mentions.
    """
    pattern = "|".join(f"(?P<{label}>{p})" for label, p in labels.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mention, ends = re.compile(pattern), re.compile(r"(?<=[.!?])\s+")
        verbs = [re.compile(p, re.IGNORECASE) for p in (WORKED_AT, STUDIED_AT, OWES_TO)]
        names = [f.split()[0] for f in SPANS.split(", ")]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.string()] * 2, *[pa.bool_()] * 3]
        for batch in batches:
            rows = []
            for doc_id, copy, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "copy", "text")), strict=True):
                for k, sentence in enumerate(ends.split(text or "")):
                    found = list(mention.finditer(sentence))
                    said = [bool(v.search(sentence)) for v in verbs] if len(found) > 1 else [False] * 3
                    rows += [(doc_id, copy, k, m.start(), m.end(), m.lastgroup, m.group(), *said) for m in found]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").mapInArrow(work, SPANS)
    return found.dropDuplicates(["doc_id", "copy", "sentence", "start"])


def near_spans(spans: DataFrame, by: list[str], band: int = BAND) -> DataFrame:
    """Each two spans of a group of which the later starts at most ``band`` after the earlier one's end: columns a and b.

    A span joins the spans that start in the band its end lies in, or in the next; spans that are empty, or lack a start or an end, take no part.
    """
    spans = spans.where("end > start")
    earlier = spans.select(*by, F.struct("*").alias("a"), F.explode(F.array(F.floor(F.col("end") / band), F.floor(F.col("end") / band) + 1)).alias("_band"))
    later = spans.select(*by, F.struct("*").alias("b"), F.floor(F.col("start") / band).alias("_band"))
    return earlier.join(later, [*by, "_band"]).where("b.start >= a.end and b.start - a.end <= " + str(int(band))).select("a", "b")


def typed_relations(docs: DataFrame, band: int = BAND) -> DataFrame:
    """doc_id, entity_a, label_a, entity_b, label_b, relation, sentence (the first with the pair), n (times near one another).

    The relation is that of the first sentence: of a person and an organisation by the sentence's verbs, of an amount and
    an organisation likewise, of a person and a time always, and RELATED_TO else.
    """
    pairs = near_spans(mention_spans(docs), ["doc_id", "copy", "sentence"], band)
    x, y = F.struct(F.lower("a.mention").alias("entity"), F.col("a.label").alias("label")), F.struct(F.lower("b.mention").alias("entity"), F.col("b.label").alias("label"))
    rows = pairs.select("a.doc_id", "a.sentence", "a.worked", "a.studied", "a.owes", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x <> y")
    both = F.array("x.label", "y.label")
    has = lambda *labels: F.arrays_overlap(both, F.array(*map(F.lit, labels)))
    relation = (
        F.when(has("PERSON") & has("ORG") & F.col("worked"), "WORKED_AT").when(has("PERSON") & has("ORG") & F.col("studied"), "STUDIED_AT")
        .when(has("AMOUNT") & has("ORG") & F.col("owes"), "OWES_TO").when(has("PERSON") & has("DATE", "DURATION"), "ACTIVE_DURING").otherwise("RELATED_TO")
    )
    found = rows.withColumn("relation", relation).groupBy("doc_id", "x", "y").agg(F.min(F.struct("sentence", "relation")).alias("first"), F.count("*").alias("n"))
    return found.select("doc_id", F.col("x.entity").alias("entity_a"), F.col("x.label").alias("label_a"), F.col("y.entity").alias("entity_b"), F.col("y.label").alias("label_b"), "first.relation", "first.sentence", "n")


# --- spans of time ---------------------------------------------------------------------------------------------------


def coalesced(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Islands of overlapping or touching spans: by, island (from 1), start, end, n_spans.

    A span begins an island if it starts after everything before it has ended.  Spans that end before they start, or lack
    a start, take no part; a null end is open and covers all that follows.
    """
    rows = spans.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    kind = dict(spans.dtypes)[end]
    last = F.coalesce(F.col(end), F.lit(OPEN_END[kind]).cast(kind))
    rows = rows.select(*by, F.col(start).alias("start"), last.alias("_last"), F.col(end).alias("end"))
    seen = running(rows, by, ["start", "_last"], {"_reach": ("max", "_last")})
    fresh = seen.withColumn("_fresh", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("int"))
    told = running(fresh.drop("_reach"), by, ["start", "_last"], {"_before": ("sum", "_fresh")})
    islands = told.groupBy(*by, (F.col("_before") + F.col("_fresh")).alias("island")).agg(F.min("start").alias("start"), F.max("_last").alias("_last"), F.max_by("end", "_last").alias("end"), F.count("*").alias("n_spans"), F.count_if(F.col("end").isNull()).alias("_open"))
    return islands.select(*by, F.col("island").cast("int").alias("island"), "start", F.when(F.col("_open") == 0, F.col("end")).alias("end"), "n_spans")


_YEARS = r"\b[0-9]{4} ?[-–—] ?(?:[0-9]{4}|[Pp]resent|[Cc]urrent|[Nn]ow)\b"
_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2} (?:to|through|until|[-–—]) [0-9]{4}-[0-9]{2}-[0-9]{2}"
_QUARTER = r"\bQ[1-4] [0-9]{4}\b"
_FISCAL = r"\bFY ?[0-9]{4}\b"


def temporal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, raw, start, end of the spans of time that texts name: years, ISO dates, quarters, fiscal years.

    An end of "present", "current" or "now" is open (null); dates that do not exist make no span; each wording counts once.
    """
    kinds = {"years": _YEARS, "dates": _ISO, "quarter": _QUARTER, "fiscal_year": _FISCAL}
    found = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))) for p in kinds.values())))
    each = F.explode(F.flatten(F.transform(F.map_entries(found), lambda e: F.transform(e["value"], lambda raw: F.struct(e["key"].alias("kind"), raw.alias("raw"))))))
    rows = docs.where("text is not null").select("doc_id", each.alias("m")).select("doc_id", "m.kind", "m.raw")
    day = lambda c: c.try_cast("date")
    year, last = F.regexp_extract("raw", "([0-9]{4})", 1), F.regexp_extract("raw", "([0-9]{4})$", 1)
    quarter = F.regexp_extract("raw", "^Q([1-4])", 1).try_cast("int")
    first = F.when(F.col("kind") == "dates", day(F.substring("raw", 1, 10))).when(F.col("kind") == "quarter", F.add_months(day(F.concat(year, F.lit("-01-01"))), (quarter - 1) * 3)).otherwise(day(F.concat(year, F.lit("-01-01"))))
    end = F.when(F.col("kind") == "dates", day(F.substring("raw", -10, 10))).when(F.col("kind") == "quarter", F.date_sub(F.add_months(day(F.concat(year, F.lit("-01-01"))), quarter * 3), 1)).when(last != "", day(F.concat(last, F.lit("-12-31"))))
    found = rows.select("doc_id", "kind", "raw", first.alias("start"), end.alias("end")).distinct()
    return found.where("start is not null and (end >= start or (end is null and kind = 'years'))")


def temporal_coverage(docs: DataFrame) -> DataFrame:
    """doc_id, island, start, end, n_spans of the time that a document's spans cover together."""
    return coalesced(temporal_spans(docs), ["doc_id"])


def open_order_periods(orders: DataFrame, items: DataFrame) -> DataFrame:
    """custkey, island, start, end, n_spans, days: times in which a customer waits for an order, from its date to its last shipment."""
    spans = orders.join(items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped")), F.col("o_orderkey") == F.col("l_orderkey"))
    spans = spans.select(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("start"), F.to_date("shipped").alias("end"))
    return coalesced(spans, ["custkey"]).withColumn("days", F.date_diff("end", "start") + 1)


# Sentences as positions in SQL: what a pattern matches, with the lengths of all that stands before.
_PATTERN = "|".join(f"(?:{p})" for p in LABELS.values()).replace("'", "''")
_KIND = "CASE " + " ".join(f"WHEN regexp_full_match(m, '{p}') THEN '{k}'" for k, p in LABELS.items()) + " END"
_SPLIT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_RELATIONS = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, md5(text) AS copy, unnest({_SPLIT}) AS s, unnest(range(len({_SPLIT}))) AS sentence FROM d),
f AS (SELECT *, regexp_extract_all(s, '{_PATTERN}') AS ms, list_transform(string_split_regex(s, '{_PATTERN}'), lambda x: length(x)) AS gaps FROM s),
e AS (SELECT doc_id, copy, sentence, s, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 1),
p AS (SELECT doc_id, copy, sentence, s, ms[i] AS m, list_sum(gaps[1 : i]) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) AS start FROM e),
q AS (SELECT *, start + length(m) AS stop, {_KIND} AS label FROM p),
j AS (
  SELECT a.doc_id, a.sentence, a.s, least((lower(a.m), a.label), (lower(b.m), b.label)) AS x, greatest((lower(a.m), a.label), (lower(b.m), b.label)) AS y
  FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.copy = b.copy AND a.sentence = b.sentence AND b.start >= a.stop AND b.start - a.stop <= {BAND}),
r AS (
  SELECT doc_id, sentence, x[1] AS entity_a, x[2] AS label_a, y[1] AS entity_b, y[2] AS label_b,
    CASE WHEN 'PERSON' IN (x[2], y[2]) AND 'ORG' IN (x[2], y[2]) AND regexp_matches(s, '(?i){WORKED_AT}') THEN 'WORKED_AT'
      WHEN 'PERSON' IN (x[2], y[2]) AND 'ORG' IN (x[2], y[2]) AND regexp_matches(s, '(?i){STUDIED_AT}') THEN 'STUDIED_AT'
      WHEN 'AMOUNT' IN (x[2], y[2]) AND 'ORG' IN (x[2], y[2]) AND regexp_matches(s, '(?i){OWES_TO}') THEN 'OWES_TO'
      WHEN 'PERSON' IN (x[2], y[2]) AND (x[2] IN ('DATE', 'DURATION') OR y[2] IN ('DATE', 'DURATION')) THEN 'ACTIVE_DURING' ELSE 'RELATED_TO' END AS relation
  FROM j WHERE x <> y)
SELECT doc_id, entity_a, label_a, entity_b, label_b, arg_min(relation, (sentence, relation)) AS relation, min(sentence)::INT AS sentence, count(*) AS n
FROM r GROUP BY ALL
"""
_RELATIONS = _RELATIONS.replace("FROM r GROUP BY ALL", "FROM r GROUP BY doc_id, entity_a, label_a, entity_b, label_b")
_SPANS_SQL = rf"""
m AS (
  SELECT doc_id, 'years' AS kind, unnest(regexp_extract_all(text, '{_YEARS}')) AS raw FROM documents
  UNION SELECT doc_id, 'dates', unnest(regexp_extract_all(text, '{_ISO}')) FROM documents
  UNION SELECT doc_id, 'quarter', unnest(regexp_extract_all(text, '{_QUARTER}')) FROM documents
  UNION SELECT doc_id, 'fiscal_year', unnest(regexp_extract_all(text, '{_FISCAL}')) FROM documents),
y AS (SELECT *, regexp_extract(raw, '[0-9]{{4}}') AS year, regexp_extract(raw, '([0-9]{{4}})$', 1) AS last, try_cast(regexp_extract(raw, '^Q([1-4])', 1) AS INT) AS q FROM m),
t AS (
  SELECT doc_id, kind, raw, CASE kind WHEN 'dates' THEN try_cast(raw[1:10] AS DATE) WHEN 'quarter' THEN (try_cast(year || '-01-01' AS DATE) + to_months((q - 1) * 3))::DATE ELSE try_cast(year || '-01-01' AS DATE) END AS "start",
    CASE WHEN kind = 'dates' THEN try_cast(right(raw, 10) AS DATE) WHEN kind = 'quarter' THEN (try_cast(year || '-01-01' AS DATE) + to_months(q * 3) - INTERVAL 1 DAY)::DATE WHEN last <> '' THEN try_cast(last || '-12-31' AS DATE) END AS "end"
  FROM y),
spans AS (SELECT * FROM t WHERE "start" IS NOT NULL AND ("end" >= "start" OR ("end" IS NULL AND kind = 'years')))"""
#: Islands another way: a span begins one if no other that starts before it (or sorts before it) reaches it.
_ISLANDS = """
r AS (SELECT *, max(coalesce("end", DATE '9999-12-31')) OVER (PARTITION BY {by} ORDER BY "start", coalesce("end", DATE '9999-12-31') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
i AS (SELECT *, sum((reach IS NULL OR "start" > reach)::INT) OVER (PARTITION BY {by} ORDER BY "start", coalesce("end", DATE '9999-12-31') ROWS UNBOUNDED PRECEDING) AS island FROM r),
g AS (SELECT {by}, island::INT AS island, min("start") AS "start", CASE WHEN count(*) = count("end") THEN max("end") END AS "end", count(*) AS n_spans FROM i GROUP BY 1, 2)"""


def queries() -> dict[str, tuple]:
    docs = lambda f: lambda spark, d: f(table(spark, d, "documents"))
    return {
        "typed_relations": (docs(typed_relations), _RELATIONS),
        "temporal_spans": (docs(temporal_spans), f'WITH {_SPANS_SQL} SELECT doc_id, kind, raw, "start", "end" FROM spans'),
        "temporal_coverage": (docs(temporal_coverage), f"WITH {_SPANS_SQL}, {_ISLANDS.format(by='doc_id')} SELECT * FROM g"),
        "open_order_periods": (
            lambda spark, d: open_order_periods(table(spark, d, "orders"), table(spark, d, "lineitem")),
            f"""WITH s AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
            spans AS (SELECT o_custkey AS custkey, o_orderdate::DATE AS "start", shipped::DATE AS "end" FROM orders JOIN s ON o_orderkey = l_orderkey WHERE shipped::DATE >= o_orderdate::DATE),
            {_ISLANDS.format(by="custkey")} SELECT *, date_diff('day', "start", "end")::INT + 1 AS days FROM g""",
        ),
    }
