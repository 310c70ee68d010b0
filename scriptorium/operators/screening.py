"""Screening of documents for personal data, secrets, private infrastructure and risk; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

text = "text"

# Patterns, levels and blend parameters.
# The last two words of the pair's names, passwd and pwd, are additions.
SECRET_PAIR = r"(?i)\b(api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*\S+"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
PRIVATE_IP = r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3})\b"
JWT = r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
CONNECTION = r"(?i)AccountKey=[A-Za-z0-9+/=]{16,}"
RISK_LEVELS = ((85, "CRITICAL"), (65, "HIGH"), (40, "MEDIUM"), (15, "LOW"))
BLEND_A, BLEND_B = 6.0, 0.5


def mask(value: Column) -> Column:
    """Short values vanish; longer ones keep two characters in front and four behind."""
    return F.when(F.length(value) <= 6, "***").otherwise(F.concat(F.substring(value, 1, 2), F.lit("***"), F.right(value, F.lit(4))))


def redacted(value: Column) -> Column:
    """Values of secret pairs and ids are replaced."""
    pairs = F.regexp_replace(value, SECRET_PAIR, "$1=[REDACTED]")
    return F.regexp_replace(pairs, UUID, "[REDACTED_ID]")


def risk_level(score: Column) -> Column:
    found = F.lit("MINIMAL")
    for least, name in reversed(RISK_LEVELS):
        found = F.when(score >= least, name).otherwise(found)
    return found


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean through a logistic curve, 0 to 100."""
    total = sum((score * weight for score, weight in parts), F.lit(0.0))
    mean = total / sum(weight for _, weight in parts)
    return 100 / (1 + F.exp(-F.lit(BLEND_A) * (mean - BLEND_B)))


def pii_counts(docs: DataFrame) -> DataFrame:
    emails, phones, ids = T.count(text, T.EMAIL), T.count(text, T.PHONE), T.count(text, T.SSN)
    rows = docs.select("doc_id", emails.alias("emails"), phones.alias("phones"), ids.alias("ids"))
    n = F.col("emails") + F.col("phones") + F.col("ids")
    return rows.select("doc_id", "emails", "phones", "ids", n.alias("pii_count"), F.round(T.clamp(n / 5), 6).alias("score"))


def pii_values(docs: DataFrame) -> DataFrame:
    """Each address found, masked."""
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(T.EMAIL), F.lit(0)))).alias("value"))
    return found.select("doc_id", F.md5("value").alias("value_md5"), mask(F.col("value")).alias("masked"))


def secrets(docs: DataFrame) -> DataFrame:
    """Secret-like findings of each document and the digest of its redacted text."""
    rows = docs.select("doc_id", "text", T.count(text, SECRET_PAIR).alias("pairs"), T.count(text, JWT).alias("tokens"), T.count(text, CONNECTION).alias("connections"), T.count(text, IPV4).alias("addresses"), T.count(text, PRIVATE_IP).alias("private_addresses"))
    return rows.select("doc_id", "pairs", "tokens", "connections", "addresses", "private_addresses", F.md5(redacted(text)).alias("redacted_md5"))


def risk(docs: DataFrame) -> DataFrame:
    """Blend of personal data, secrets, hedging and repetition into one risk score and level."""
    rows = docs.select("doc_id", "text", T.words(text).alias("w"), (T.count(text, T.EMAIL) + T.count(text, T.PHONE) + T.count(text, T.SSN)).alias("pii"), (T.count(text, SECRET_PAIR) + T.count(text, JWT)).alias("secret"), T.count(text, PRIVATE_IP).alias("private"))
    n = F.greatest(F.size("w"), F.lit(1))
    hedging = T.clamp(F.size(F.filter("w", lambda x: x.isin(*T.HEDGES))) / n * 5)
    repeated = 1 - F.size(F.array_distinct("w")) / n
    score = F.round(blend([(T.clamp(F.col("pii") / 5), 0.4), (T.clamp(F.col("secret") / 2), 0.3), (T.clamp(F.col("private") / 2), 0.1), (hedging, 0.1), (repeated, 0.1)]), 4)
    scored = rows.select("doc_id", "pii", "secret", "private", score.alias("risk"))
    return scored.select("*", risk_level(F.col("risk")).alias("level"), F.when(F.col("risk") >= 75, "HIGH").when(F.col("risk") >= 45, "MEDIUM").otherwise("LOW").alias("band"))


def numeric_units(docs: DataFrame) -> DataFrame:
    """Numbers that stand with more than one unit in a document."""
    found = F.regexp_extract_all(text, F.lit(T.ascii_edges(r"\b(\d+(?:\.\d+)?)[ \t\n\f\r]?([A-Za-z%]{1,12})\b")), F.lit(0))
    pairs = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", F.regexp_extract("m", r"^([\d.]+)", 1).alias("value"), F.lower(F.regexp_extract("m", r"([A-Za-z%]+)$", 1)).alias("unit"))
    return pairs.groupBy("doc_id", "value").agg(F.countDistinct("unit").alias("units"), F.count("*").alias("n")).where("units > 1")


def queries() -> dict[str, tuple]:
    on = lambda operator: lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))
    esc = lambda p: p.replace("'", "''")
    cnt = lambda p: f"len(regexp_extract_all(text, '{esc(p)}'))"
    w = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
    level = "CASE " + " ".join(f"WHEN risk >= {n} THEN '{name}'" for n, name in RISK_LEVELS) + " ELSE 'MINIMAL' END"
    clamp = lambda e: f"greatest(0, least(1, {e}))"
    return {
        "pii_counts": (on(pii_counts), f"WITH t AS (SELECT doc_id, {cnt(T.EMAIL)} AS emails, {cnt(T.PHONE)} AS phones, {cnt(T.SSN)} AS ids FROM documents) SELECT *, emails + phones + ids AS pii_count, round({clamp('(emails + phones + ids)::DOUBLE / 5')}, 6) AS score FROM t"),
        "mask_values": (on(pii_values), f"WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{esc(T.EMAIL)}'))) AS v FROM documents) SELECT doc_id, md5(v) AS value_md5, CASE WHEN length(v) <= 6 THEN '***' ELSE substr(v, 1, 2) || '***' || right(v, 4) END AS masked FROM t"),
        "secret_redact": (
            on(secrets),
            f"SELECT doc_id, {cnt(SECRET_PAIR)} AS pairs, {cnt(JWT)} AS tokens, {cnt(CONNECTION)} AS connections, {cnt(IPV4)} AS addresses, {cnt(PRIVATE_IP)} AS private_addresses, md5(regexp_replace(regexp_replace(text, '{esc(SECRET_PAIR)}', '\\1=[REDACTED]', 'g'), '{UUID}', '[REDACTED_ID]', 'g')) AS redacted_md5 FROM documents",
        ),
        "risk_blend": (
            on(risk),
            f"""WITH t AS (SELECT doc_id, {cnt(T.EMAIL)} + {cnt(T.PHONE)} + {cnt(T.SSN)} AS pii, {cnt(SECRET_PAIR)} + {cnt(JWT)} AS secret, {cnt(PRIVATE_IP)} AS private, {w} AS w FROM documents),
            x AS (SELECT *, {clamp('pii::DOUBLE / 5')} * 0.4::DOUBLE + {clamp('secret::DOUBLE / 2')} * 0.3::DOUBLE + {clamp('private::DOUBLE / 2')} * 0.1::DOUBLE
              + {clamp(f"len(list_filter(w, lambda x: list_contains({list(T.HEDGES)}, x)))::DOUBLE / greatest(len(w), 1) * 5")} * 0.1::DOUBLE + (1 - len(list_distinct(w))::DOUBLE / greatest(len(w), 1)) * 0.1::DOUBLE AS m FROM t),
            y AS (SELECT doc_id, pii, secret, private, round(100 / (1 + exp(-6 * (m - 0.5::DOUBLE))), 4) AS risk FROM x)
            SELECT *, {level} AS level, CASE WHEN risk >= 75 THEN 'HIGH' WHEN risk >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM y""",
        ),
        "numeric_units": (
            on(numeric_units),
            r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d+(?:\.\d+)?)\s?([A-Za-z%]{1,12})\b')) AS m FROM documents),
            p AS (SELECT doc_id, regexp_extract(m, '^([\d.]+)', 1) AS value, lower(regexp_extract(m, '([A-Za-z%]+)$', 1)) AS unit FROM m)
            SELECT doc_id, value, count(DISTINCT unit) AS units, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(DISTINCT unit) > 1""",
        ),
    }
