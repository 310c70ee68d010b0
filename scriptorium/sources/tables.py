"""Table access and tenant scoping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scoped(df: DataFrame, *, profile: str, column: str = "source", **equal) -> DataFrame:
    """Rows of one profile, with optional equality (one value) or membership (several) filters; a blank scope is an error."""
    if not profile or not profile.strip():
        raise ValueError("a profile is required")
    df = df.where(F.col(column) == profile)
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def select_only(query: str) -> str:
    """The query, if it is one plain SELECT; writes and stacked statements are refused."""
    low = query.strip().lower()
    if not low.startswith("select") or any(w in low for w in (";--", "drop ", "delete ", "update ", "insert ")):
        raise ValueError("only SELECT statements are allowed")
    return query


def run_select(spark: SparkSession, query: str, limit: int = 200) -> DataFrame:
    return spark.sql(select_only(query)).limit(limit)


#: Paths written by ``durable``, one list for each open ``scratch``.
_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and everything runs in one JVM."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scriptorium-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends here, columns prune, executors may go.

    Inside a ``scratch`` the table goes with it, or, if to ``keep``, with the scratch around that one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scriptorium/{tag}-{uuid.uuid4().hex}"
    open_lists = _written[:-1] if keep else _written
    if open_lists:
        open_lists[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``durable`` wrote inside it without ``keep``: nothing may read them later."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            delete(spark, path)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a count proves that ``df`` has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for a broadcast if a count proves that it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df
