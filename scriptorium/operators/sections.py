"""Headings and the paths of sections below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .ordering import running

#: Levels that are told apart; deeper headings count as of the deepest.
DEEPEST = 6
UNTITLED = "Untitled Section"


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, pos (line, from 0), level, title of heading lines.

    Marks (``## Title``) and numbers (``2.1 Title``) give their depth; short capitalised lines without a final mark are of
    the second level, of the first if all in capitals.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", T.strip(F.col("line")).alias("line")).where("line <> ''")
    marks, number = F.regexp_extract("line", r"^(#{1,6})\s+\S", 1), F.regexp_extract("line", r"^(\d+(\.\d+)*)\.?\s+[A-Z]", 1)
    short = F.rlike("line", F.lit("^[A-Z]")) & (F.length("line") <= 60) & ~F.rlike("line", F.lit("[.!?,;]$")) & (F.size(F.split("line", r"\s+")) <= 6)
    capitals = F.rlike("line", F.lit("^[A-Z][A-Z ]+$"))
    level = F.when(marks != "", F.length(marks)).when((number != "") & (F.length("line") <= 80), F.regexp_count(number, F.lit(r"\.")) + 1).when(short & capitals, 1).when(short, 2)
    return lines.select("doc_id", "pos", level.cast("int").alias("level"), F.regexp_replace("line", r"^#{1,6}\s+", "").alias("title")).where("level is not null")


def section_paths(heads: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """doc_id, pos, level, title, path of each heading: the titles of the headings it stands below, joined by " > ".

    An earlier heading is above it if it is shallower and no heading as shallow or shallower came in between.  So of each
    level the last heading before is enough; it is still open if none of the shallower levels had a later one.

    Defined results: blank and null titles read "Untitled Section", null and zero levels 1, negative ones are shallower
    than 1 and count as 1; rows that repeat a place are taken in order of level and title; no headings, no rows.
    """
    title = F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.lit(UNTITLED))
    level = F.least(F.greatest(F.coalesce(F.nullif("level", F.lit(0)), F.lit(1)), F.lit(1)), F.lit(deepest)).cast("int")
    rows = heads.select("doc_id", "pos", level.alias("level"), title.alias("title"))
    own = {k: F.when(F.col("level") == k, F.struct("pos", "title")) for k in range(1, deepest)}
    rows = running(rows.select("*", *(e.alias(f"_own{k}") for k, e in own.items())), ["doc_id"], ["pos", "level", "title"], {f"_last{k}": ("last", f"_own{k}") for k in own})
    above, open_ = [], F.lit(-1)
    for k in own:
        at = F.col(f"_last{k}.pos")
        above.append(F.when((F.col("level") > k) & (at > open_), F.col(f"_last{k}.title")))
        open_ = F.greatest(open_, F.coalesce(at, F.lit(-1)))
    return rows.select("doc_id", "pos", "level", "title", F.concat_ws(" > ", *above, "title").alias("path"))


def sections_with_paths(docs: DataFrame) -> DataFrame:
    return section_paths(headings(docs)).select("doc_id", "pos", "level", F.md5("title").alias("title_md5"), F.size(F.split("path", " > ")).alias("depth"), F.md5("path").alias("path_md5"))


#: The stack said otherwise: an earlier, shallower heading with none as shallow or shallower in between.
_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS s FROM documents),
n AS (SELECT doc_id, pos, regexp_replace(s, '^\s+|\s+$', '', 'g') AS line FROM l),
c AS (SELECT *, regexp_extract(line, '^(#{1,6})\s+\S', 1) AS marks, regexp_extract(line, '^(\d+(\.\d+)*)\.?\s+[A-Z]', 1) AS number,
  regexp_matches(line, '^[A-Z]') AND length(line) <= 60 AND NOT regexp_matches(line, '[.!?,;]$') AND len(regexp_split_to_array(line, '\s+')) <= 6 AS short FROM n WHERE line <> ''),
h AS (
  SELECT doc_id, pos, regexp_replace(line, '^#{1,6}\s+', '') AS title,
    least(6, CASE WHEN marks <> '' THEN length(marks) WHEN number <> '' AND length(line) <= 80 THEN len(regexp_extract_all(number, '\.')) + 1
      WHEN short AND regexp_matches(line, '^[A-Z][A-Z ]+$') THEN 1 WHEN short THEN 2 END) AS level
  FROM c WHERE marks <> '' OR (number <> '' AND length(line) <= 80) OR short),
up AS (
  SELECT a.doc_id, a.pos, string_agg(b.title, ' > ' ORDER BY b.pos) AS above
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level
  WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.doc_id = a.doc_id AND x.pos > b.pos AND x.pos < a.pos AND x.level <= b.level)
  GROUP BY 1, 2)
SELECT h.doc_id, h.pos::INT AS pos, level::INT AS level, md5(title) AS title_md5, len(string_split(coalesce(above || ' > ', '') || title, ' > '))::INT AS depth, md5(coalesce(above || ' > ', '') || title) AS path_md5
FROM h LEFT JOIN up USING (doc_id, pos)
"""


def queries() -> dict[str, tuple]:
    return {"section_paths": (lambda spark, d: sections_with_paths(table(spark, d, "documents")), _SQL)}
