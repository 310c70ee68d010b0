"""Bounded, repeatable samples of rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30


def ticket(key: str, salt: int) -> Column:
    """A number in 0 ... 2**30 - 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(_SPACE))


def bounded(rows: DataFrame, key: str, most: int, salt: int = 1) -> DataFrame:
    """About ``most`` rows of ``rows`` (all, if fewer), chosen by a hash of ``key``; one count, no sort."""
    there = rows.count()
    return rows if there <= most else rows.where(ticket(key, salt) < int(most / there * _SPACE))


def bounded_texts(rows: DataFrame, key: str, most: int, most_bytes: int, salt: int = 1) -> DataFrame:
    """About ``most`` rows of ``rows`` with about ``most_bytes`` of ``text`` in all, chosen by a hash of ``key``.

    Texts of a hundredth of the bytes and more are not learned from: one of them would outweigh many others.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = rows.where(size <= most_bytes // 100)
    there, total = rows.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    share = min(1.0, most / max(1, there), most_bytes / max(1, total))
    return rows if share >= 1 else rows.where(ticket(key, salt) < int(share * _SPACE))


def bounded_by_class(rows: DataFrame, key: str, label: str, most: int, salt: int = 1) -> DataFrame:
    """About ``most`` rows of each class; classes are few (languages, labels)."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0)
    for value, n in counts.items():
        limit = F.when(F.col(label) == F.lit(value), F.lit(min(_SPACE, int(most / n * _SPACE)))).otherwise(limit)
    return rows.where(ticket(key, salt) < limit)
