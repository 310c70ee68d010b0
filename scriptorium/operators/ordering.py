"""Places within large groups: exact row numbers without one task per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..sources.tables import durable, small


def placed(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 1, in ascending ``order``, which must be unique within a group) and ``group_rows``.

    Rows are dealt by ranges of group and order, so a group of any size spreads over many tasks; what stands before a
    range comes from one count for each group and range.
    """
    keys = [F.col(c) for c in (*by, *order)]
    dealt = durable(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "placed")
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_rows"))
    group = W.Window.partitionBy(*by)
    offsets = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), (F.sum("_rows").over(group.orderBy("_part")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(group).alias("group_rows"))
    same = reduce(lambda a, b: a & b, [dealt[c].eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_p"))
    joined = dealt.join(small(offsets), same)
    inside = W.Window.partitionBy(*by, "_part").orderBy(*order)
    return joined.withColumn("place", F.row_number().over(inside) + F.col("_before")).select(*rows.columns, "place", "group_rows")


def _last(value: Column, before: Column) -> Column:
    return F.coalesce(value, before)


#: How a running value is taken within rows, and how what came before a range of rows goes in.
RUNNING = {
    "last": (lambda c: F.last(c, ignorenulls=True), _last),
    "max": (F.max, F.greatest),
    "sum": (F.sum, lambda value, before: F.coalesce(value, F.lit(0)) + F.coalesce(before, F.lit(0))),
}


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with, for each name in ``values``, the last, max or sum (nulls aside) of a column over the rows before.

    ``values`` maps a new name to (kind, column).  Groups and places are as in ``placed``: rows are dealt by ranges of
    group and order, and each range starts with what the ranges before it in its group end with, so one group of any
    size spreads over many tasks.  Rows of equal order come in any order.
    """
    rows = durable(rows, "running-rows")  # dealing by ranges reads them twice
    keys = [F.col(c) for c in (*by, *order)]
    dealt = durable(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "running")
    at = F.struct(*order)
    whole = {name: F.max_by(c, F.when(F.col(c).isNotNull(), at)) if kind == "last" else RUNNING[kind][0](F.col(c)) for name, (kind, c) in values.items()}
    parts = dealt.groupBy(*by, "_part").agg(*(e.alias(f"_{name}") for name, e in whole.items()))
    earlier = W.Window.partitionBy(*by).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    before = parts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_p"), *(RUNNING[kind][0](F.col(f"_{name}")).over(earlier).alias(f"_{name}") for name, (kind, _) in values.items()))
    same = reduce(lambda a, b: a & b, [dealt[c].eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_part") == F.col("_p"))
    inside = W.Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.Window.unboundedPreceding, -1)
    made = [RUNNING[kind][1](RUNNING[kind][0](F.col(c)).over(inside), F.col(f"_{name}")).alias(name) for name, (kind, c) in values.items()]
    return dealt.join(small(before), same).select(*rows.columns, *made)
