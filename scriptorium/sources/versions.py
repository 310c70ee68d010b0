"""Tables whose rows are replaced in one step: versioned snapshots behind a manifest that is written last.

A table is a folder.  Rows lie in buckets by the hash of their key, each bucket in a folder of its own that is never
written again; a manifest names the folder of every bucket, and the manifest with the largest number is the table.  A
change writes new folders for the buckets it touches and then the next manifest, by a rename that fails if that number is
taken.  So a job that dies on the way leaves the old version as it was, a reader sees one version throughout, and of two
writers that started from the same version only one succeeds.

Everything goes through Spark's own file systems, so any store will do that renames a file at once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import delete

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has made the next version first."""


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of all versions that can be read, in order."""
    store, where = _store(spark, f"{folder}/_manifests")
    if not store.exists(where):
        return []
    names = [s.getPath().getName() for s in store.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int) -> dict:
    text = spark.read.text(f"{folder}/_manifests/{version}.json", wholetext=True).first()
    return json.loads(text["value"])


def _commit(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """Write the manifest beside its place and rename it there: it appears whole, and only if the number is free."""
    beside = f"{folder}/_manifests/.{version}-{uuid.uuid4().hex}"
    store, where = _store(spark, beside)
    out = store.create(where, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, place = _store(spark, f"{folder}/_manifests/{version}.json")
    if store.exists(place) or not store.rename(where, place):
        store.delete(where, False)
        raise Conflict(f"version {version} of {folder} exists")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The table, or an earlier version of it."""
    known = versions(spark, folder)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{folder} has no version {'at all' if version is None else version}")
    found = manifest(spark, folder, known[-1] if version is None else version)
    schema, parts = StructType.fromJson(found["schema"]), sorted(set(found["buckets"].values()))
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/{p}" for p in parts))


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def replace(folder: str, rows: DataFrame, key: list[str], remove: DataFrame | None = None, scope: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """Delete and insert in one version; returns its number.

    ``remove`` (columns ``key``) goes first, then ``rows`` take the place of rows with their keys.  With ``scope`` the keys
    are dealt and replaced by that prefix of the key: all rows of a scope that ``rows`` or ``remove`` name go, so that a
    document's sections are replaced as a whole.  Only the buckets of the keys named are read and written.

    Defined results: rows that repeat a key within ``rows`` all stay (a replacement, not a merge); null keys are keys;
    nothing to insert and nothing to remove makes a version equal to the last; the table's columns are those of its first
    version.
    """
    spark, by = rows.sparkSession, scope or key
    known = versions(spark, folder)
    last = manifest(spark, folder, known[-1]) if known else {"buckets": {}, "schema": rows.schema.jsonValue(), "by": by, "n": buckets}
    if last["by"] != by:
        raise ValueError(f"the table's rows are dealt by {last['by']}")
    schema, n = StructType.fromJson(last["schema"]), last["n"]
    rows = rows.select(*schema.fieldNames())
    gone = rows.select(*by) if remove is None else rows.select(*by).unionByName(remove.select(*by))
    touched = sorted(r[0] for r in gone.select(_bucket(by, n)).distinct().collect())  # at most ``buckets``
    fresh = rows.withColumn("_bucket", _bucket(by, n))
    before = sorted({last["buckets"][str(b)] for b in touched if str(b) in last["buckets"]})
    if before:
        old = spark.read.schema(schema).parquet(*(f"{folder}/{p}" for p in before))
        names = [f"_gone_{c}" for c in by]
        out = gone.distinct().toDF(*names)
        same = F.lit(True)
        for c, g in zip(by, names, strict=True):
            same = same & old[c].eqNullSafe(out[g])
        kept = old.join(out, same, "left_anti").withColumn("_bucket", _bucket(by, n))
        # A folder may hold more buckets than those touched; the others keep theirs.
        fresh = kept.where(F.col("_bucket").isin(touched)).unionByName(fresh)
    if not touched:
        _commit(spark, folder, (known[-1] if known else 0) + 1, last)
        return (known[-1] if known else 0) + 1
    name = f"data-{uuid.uuid4().hex}"
    # A bucket that holds most rows is split among tasks.
    fresh.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{folder}/{name}")
    store, where = _store(spark, f"{folder}/{name}")
    there = {s.getPath().getName() for s in store.listStatus(where)}
    moved = {str(b): f"{name}/_bucket={b}" for b in touched if f"_bucket={b}" in there}
    left = {b: p for b, p in last["buckets"].items() if int(b) not in touched}
    version = (known[-1] if known else 0) + 1
    _commit(spark, folder, version, last | {"buckets": left | moved})
    return version


def expire(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions and the data that none of those reads; returns the folders deleted.

    Data of a job that has died is deleted as well; no writer may be at work meanwhile.
    """
    known = versions(spark, folder)
    for version in known[:-keep]:
        delete(spark, f"{folder}/_manifests/{version}.json")
    read_by = {p.split("/")[0] for v in known[-keep:] for p in manifest(spark, folder, v)["buckets"].values()}
    store, where = _store(spark, folder)
    gone = sorted(s.getPath().getName() for s in store.listStatus(where) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in read_by)
    for name in gone:
        delete(spark, f"{folder}/{name}")
    return gone
