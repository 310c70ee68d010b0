"""Paged stores, versioned tables, cache rows with a lifetime, schemas by evidence."""

import json
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import schema_evidence
from scriptorium.sources import pages, versions
from scriptorium.streaming import cache


def store(folder, ids, size=10):
    os.makedirs(folder, exist_ok=True)
    ids = sorted(ids)
    for at in range(0, len(ids), size):
        some = ids[at : at + size]
        with open(f"{folder}/page-{some[0]}-{some[-1]}.jsonl", "w") as file:
            for k in some:
                payload = {"profile_id": "p"} if k % 3 else {"provenance": {"profile_id": "q"}}
                payload |= {"text": "" if k % 5 == 0 else f"text {k}", "content": f"content {k}"} | ({"doc_id": k} if k % 2 else {})
                file.write(json.dumps({"id": k, "payload": payload}) + "\n")


def expected(ids):
    return sorted((k, "p" if k % 3 else "q", str(k) if k % 2 else None, f"content {k}" if k % 5 == 0 else f"text {k}") for k in ids)


def test_a_paged_store_is_read_in_parallel_and_leaves_pages_out(spark, tmp_path):
    pages.registered(spark)
    store(f"{tmp_path}/s", range(95))
    frame = spark.read.format("paged_store").option("path", f"{tmp_path}/s").load()
    assert sorted(map(tuple, frame.select("id", "profile", "document", "text").collect())) == expected(range(95))
    assert frame.rdd.getNumPartitions() == 10
    for rule, ids, parts in (("id >= 41 and id < 60", range(41, 60), 2), ("id = 7", [7], 1), ("id in (3, 94, 200)", [3, 94], 2), ("id > 1000", [], 1), ("id <= 9 and profile = 'q'", [0, 3, 6, 9], 1)):
        found = frame.where(rule)
        assert sorted(r["id"] for r in found.collect()) == list(ids), rule
        assert found.rdd.getNumPartitions() == parts, rule
    named = spark.read.format("paged_store").option("path", f"{tmp_path}/s").option("text", "content").load()
    assert named.where("id = 1").first()["text"] == "content 1"
    os.makedirs(f"{tmp_path}/none")
    assert spark.read.format("paged_store").option("path", f"{tmp_path}/none").load().count() == 0


def test_a_paged_store_as_a_stream_goes_on_after_a_restart(spark, tmp_path):
    pages.registered(spark)
    store(f"{tmp_path}/s", range(25))
    seen = []

    def run():
        rows = spark.readStream.format("paged_store").option("path", f"{tmp_path}/s").load().select("id")
        query = rows.writeStream.foreachBatch(lambda batch, _: seen.extend(r["id"] for r in batch.collect())).option("checkpointLocation", f"{tmp_path}/c").start()
        query.processAllAvailable()
        query.stop()

    run()
    assert sorted(seen) == list(range(25))
    store(f"{tmp_path}/s", range(25, 60))
    run()
    assert sorted(seen) == list(range(60))


def test_pages_written_by_tasks_are_read_back(spark, tmp_path):
    pages.registered(spark)
    rows = spark.range(500).select("id", F.struct(F.concat(F.lit("t"), "id").alias("text"), F.lit("p").alias("profile_id")).alias("payload"))
    pages.write_pages(rows, f"{tmp_path}/s", 60)
    frame = spark.read.format("paged_store").option("path", f"{tmp_path}/s").load()
    assert sorted((r["id"], r["text"], r["profile"]) for r in frame.collect()) == [(k, f"t{k}", "p") for k in range(500)]


SCHEMA = "doc string, section int, v string"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_replacing_scopes_makes_versions(spark, tmp_path):
    folder, r = f"{tmp_path}/t", random.Random(1)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder)
    state, history = {}, []
    for step in range(5):
        docs = [r.choice("abcdefgh") for _ in range(3)]
        rows = [(d, s, f"{step}{s}") for d in dict.fromkeys(docs) for s in range(r.randint(1, 3))] + ([(None, 1, "n")] if step == 2 else [])
        gone = [r.choice("abcdefgh")] if step else []
        for d in gone + [x[0] for x in rows]:
            state.pop(d, None)
        for x in rows:
            state.setdefault(x[0], []).append(x)
        remove = spark.createDataFrame([(d, 0) for d in gone], "doc string, section int") if gone else None
        assert versions.replace(folder, spark.createDataFrame(rows, SCHEMA), ["doc", "section"], remove, scope=["doc"], buckets=4) == step + 1
        history.append(sorted((x for some in state.values() for x in some), key=repr))
        assert rows_of(versions.read(spark, folder)) == history[-1]
    assert [rows_of(versions.read(spark, folder, k + 1)) for k in range(5)] == history
    versions.expire(spark, folder, 2)
    assert versions.versions(spark, folder) == [4, 5] and rows_of(versions.read(spark, folder, 4)) == history[3]
    empty = spark.createDataFrame([], SCHEMA)
    assert versions.replace(folder, empty, ["doc"], buckets=4) == 6 and rows_of(versions.read(spark, folder)) == history[4]


def test_a_job_that_dies_between_its_writes_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/t"
    versions.replace(folder, spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], SCHEMA), ["doc"])

    def dies(*_):
        raise SystemExit("killed")

    with monkeypatch.context() as m:
        m.setattr(versions, "_commit", dies)
        with pytest.raises(SystemExit):
            versions.replace(folder, spark.createDataFrame([("a", 1, "new")], SCHEMA), ["doc"])
    broken = spark.createDataFrame([("a", 1, "x")], SCHEMA).withColumn("v", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        versions.replace(folder, broken.select("doc", "section", F.col("v").cast("string").alias("v")), ["doc"])
    assert rows_of(versions.read(spark, folder)) == [("a", 1, "old"), ("b", 1, "old")] and versions.versions(spark, folder) == [1]
    assert len(versions.expire(spark, folder)) >= 1  # what the dead jobs left
    assert rows_of(versions.read(spark, folder)) == [("a", 1, "old"), ("b", 1, "old")]


def test_of_two_writers_one_succeeds(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/t"
    versions.replace(folder, spark.createDataFrame([("a", 1, "1")], SCHEMA), ["doc"])
    commit = versions._commit

    def late(spark_, folder_, version, content):
        monkeypatch.setattr(versions, "_commit", commit)
        versions.replace(folder_, spark.createDataFrame([("a", 1, "first")], SCHEMA), ["doc"])
        commit(spark_, folder_, version, content)

    monkeypatch.setattr(versions, "_commit", late)
    with pytest.raises(versions.Conflict):
        versions.replace(folder, spark.createDataFrame([("a", 1, "second")], SCHEMA), ["doc"])
    assert rows_of(versions.read(spark, folder)) == [("a", 1, "first")]


T0 = datetime(2024, 1, 1)


def plain_cache(rows, lifetime, refresh):
    held, out = {}, []
    for key, ts, value in sorted(rows, key=lambda x: (x[1], x[2] is not None, x[2] or "")):
        if value is not None:
            held[key] = (value, ts + timedelta(milliseconds=lifetime))
            continue
        hit = key in held and ts < held[key][1]
        out.append((key, ts, hit, held[key][0] if hit else None))
        if hit and refresh:
            held[key] = (held[key][0], ts + timedelta(milliseconds=lifetime))
    return sorted(out, key=repr)


@pytest.mark.parametrize("refresh", [False, True])
def test_cache_rows_expire_at_the_edge(spark, tmp_path, refresh):
    edge = [("k", T0, "v"), ("k", T0 + timedelta(seconds=59.999), None), ("k", T0 + timedelta(seconds=60), None), ("k", T0 + timedelta(seconds=119), None), ("none", T0, None), ("k", T0, None)]
    r = random.Random(8)
    rows = edge + [(r.choice("abcde"), T0 + timedelta(seconds=300 + k * 7 + r.randint(0, 5)), r.choice([None, None, f"v{k}"])) for k in range(120)]
    schema = "key string, ts timestamp, value string"
    for i in range(0, len(rows), 21):
        spark.createDataFrame(rows[i : i + 21], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = plain_cache(rows, 60_000, refresh)
    if not refresh:
        assert rows_of(cache.cached(spark.createDataFrame(rows, schema), 60_000)) == want
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = cache.cached(stream, 60_000, late="2 hours", refresh=refresh).writeStream.format("memory").queryName(f"cache{refresh}").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert rows_of(spark.table(f"cache{refresh}")) == want


def test_the_state_holds_living_entries_only(spark, tmp_path):
    schema = "key string, ts timestamp, value string"
    for hour in range(6):
        rows = [(f"{hour}-{k}", T0 + timedelta(hours=hour, seconds=k), "v") for k in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = cache.cached(stream, 60_000, late="1 minute").writeStream.format("memory").queryName("cache_state").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    query.processAllAvailable()
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert kept and kept[-1] <= 3 * 20 * 3  # of 120 entries put, those of the last hours at most, with their timers


def test_schema_of_nested_clashing_and_null_values_like_sql(spark, tmp_path):
    texts = ['{"a": 1, "b": {"c": null, "d": [1, 2.5, null]}, "e": ""}', '{"a": 2.5, "b": {"c": null, "d": []}, "e": "two words"}', '{"a": 3, "f": true, "b": "text"}', "[]", "null", None, '{"f": 1, "x": [{"y": "z"}, {"y": 4}]}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, props string")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    answer = con.execute(schema_evidence._SQL)
    columns = [c[0] for c in answer.description]
    got = schema_evidence.schema_evidence(frame, "props")
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(answer.fetchall(), key=repr)
    types = {r["path"]: r["type"] for r in got.collect()}
    assert types == {"$": "mixed", "$.a": "number", "$.b": "mixed", "$.b.c": "null", "$.b.d": "array", "$.b.d[]": "number", "$.e": "string", "$.f": "mixed", "$.x": "array", "$.x[]": "object", "$.x[].y": "mixed"}
    assert schema_evidence.text_field(got) == "$.e"
    odd = schema_evidence.schema_evidence(spark.createDataFrame([("{broken",)], "props string"), "props").collect()
    assert [(r["path"], r["type"]) for r in odd] == [("$", "invalid")]
    assert schema_evidence.schema_evidence(frame.limit(0), "props").count() == 0
