"""The schema of nested values by what they hold: types by path, merged in a lattice, with evidence for each.

Types are ordered: nothing known, then null, below everything else; integers below numbers; of any other two types only
"mixed" is above both.  Merging is associative and does not depend on order, so tasks merge their own rows and Spark the
tasks'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import table

_FIELDS = ("path", "type", "n", "n_filled", "chars", "tokens")


def observed(value: object, path: str = "$") -> Iterator[tuple[str, str, object]]:
    """Path, type and value of a JSON value and all below it; array elements share the path ``[]``."""
    kind = "null" if value is None else {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(value)]
    yield path, kind, value
    if kind == "object":
        for key, below in value.items():
            yield from observed(below, f"{path}.{key}")
    elif kind == "array":
        for below in value:
            yield from observed(below, f"{path}[]")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, str], list[int]] = {}
        for text in batch.column("text").to_pylist():
            try:
                seen = list(observed(json.loads(text)))
            except (ValueError, RecursionError):
                seen = [("$", "invalid", None)]
            for path, kind, value in seen:
                at = found.setdefault((path, kind), [0, 0, 0, 0])
                at[0] += 1
                if kind == "string":
                    at[1] += value != ""
                    at[2] += len(value)
                    at[3] += len(value.split())
                else:
                    at[1] += kind not in ("null", "invalid") and value not in ({}, [])
        rows = [(path, kind, *counts) for (path, kind), counts in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], list(_FIELDS))


def joined(types: Column) -> Column:
    """The least type above all of an array of them."""
    real = F.array_sort(F.array_except(types, F.array(F.lit("null"), F.lit("invalid"))))
    number = F.array_except(real, F.array(F.lit("integer"), F.lit("number")))
    return F.when(F.size(real) == 0, F.when(F.array_contains(types, "null"), "null").otherwise("invalid")).when(F.size(real) == 1, real[0]).when(F.size(number) == 0, "number").otherwise("mixed")


def schema_evidence(rows: DataFrame, column: str) -> DataFrame:
    """path, type, types, n, n_null, filled, mean_chars, mean_tokens of every path that JSON texts hold.

    ``n`` counts values, nulls among them; ``filled`` is the share that is neither null nor empty; the means are over
    strings.

    Defined results: null texts are no values; what is no JSON counts at ``$`` as "invalid"; a path with clashing types is
    "mixed", one with nulls alone "null"; keys with dots are not told from nesting; empty tables give no rows.
    """
    counted = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).mapInArrow(_counted, "path string, type string, n long, n_filled long, chars long, tokens long")
    each = counted.groupBy("path", "type").agg(*(F.sum(c).alias(c) for c in _FIELDS[2:]))
    types, strings = F.array_sort(F.collect_set("type")), F.sum(F.when(F.col("type") == "string", F.col("n")))  # types are seven at the most
    by = each.groupBy("path").agg(types.alias("types"), F.sum("n").alias("n"), F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("n_null"), F.sum("n_filled").alias("n_filled"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), strings.alias("strings"))
    mean = lambda c: F.round(F.col(c) / F.col("strings"), 6)
    return by.select("path", joined(F.col("types")).alias("type"), F.array_join("types", ",").alias("types"), "n", "n_null", F.round(F.col("n_filled") / F.col("n"), 6).alias("filled"), mean("chars").alias("mean_chars"), mean("tokens").alias("mean_tokens"))


def text_field(evidence: DataFrame) -> str | None:
    """The path that is likeliest the text: strings, most often filled, then longest."""
    best = evidence.where("type = 'string' and filled > 0").orderBy(F.desc("filled"), F.desc("mean_chars"), F.desc("mean_tokens"), "path").first()
    return best and best["path"]


_SQL = r"""
WITH RECURSIVE v AS (
  SELECT '$' AS path, props::JSON AS j FROM events WHERE props IS NOT NULL
  UNION ALL
  SELECT u.path, u.j FROM v, LATERAL (
    SELECT unnest(CASE json_type(v.j) WHEN 'OBJECT' THEN list_transform(json_keys(v.j), lambda k: {'path': v.path || '.' || k, 'j': json_extract(v.j, '$."' || k || '"')})
      WHEN 'ARRAY' THEN list_transform(range(json_array_length(v.j)::BIGINT), lambda i: {'path': v.path || '[]', 'j': json_extract(v.j, '$[' || i || ']')}) ELSE [] END) AS e) x, LATERAL (SELECT x.e.path AS path, x.e.j AS j) u),
t AS (SELECT path, j, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS type, j ->> '$' AS s FROM v),
g AS (SELECT path, list_sort(list_distinct(list(type))) AS types, count(*) AS n, count(*) FILTER (WHERE type = 'null') AS n_null,
  count(*) FILTER (WHERE type <> 'null' AND NOT (type = 'string' AND s = '') AND j::VARCHAR NOT IN ('{}', '[]')) AS n_filled,
  sum(length(s)) FILTER (WHERE type = 'string') AS chars, sum(len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> ''))) FILTER (WHERE type = 'string') AS tokens, count(*) FILTER (WHERE type = 'string') AS strings FROM t GROUP BY 1),
r AS (SELECT *, list_filter(types, lambda x: x <> 'null') AS real FROM g)
SELECT path, CASE WHEN len(real) = 0 THEN 'null' WHEN len(real) = 1 THEN real[1] WHEN len(list_filter(real, lambda x: x NOT IN ('integer', 'number'))) = 0 THEN 'number' ELSE 'mixed' END AS type,
  array_to_string(types, ',') AS types, n, n_null, round(n_filled / n, 6) AS filled, round(chars / nullif(strings, 0), 6)::DOUBLE AS mean_chars, round(tokens / nullif(strings, 0), 6)::DOUBLE AS mean_tokens
FROM r
"""


def queries() -> dict[str, tuple]:
    return {"schema_evidence": (lambda spark, d: schema_evidence(table(spark, d, "events"), "props"), _SQL)}
