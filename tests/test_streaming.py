"""Streams against their batch counterparts."""

from pyspark.sql import functions as F

from scriptorium.streaming import events as S

DATA = "/root/testdata/sf0.001"


def split_events(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    ordered = rows.orderBy("ts").limit(10_000)
    ordered.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/events")
    return rows, S.event_stream(spark, f"{tmp_path}/events", rows.schema)


def drain(stream, name, mode="complete"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_hourly_stream_equals_batch(spark, tmp_path):
    rows, stream = split_events(spark, tmp_path)
    batch = S.hourly(rows.withColumn("ts", F.col("ts").cast("timestamp")))
    got = drain(S.hourly(stream), "hourly")
    key = lambda r: (r.hour, r.event_type, r.n, round(r.total, 6), r.low, r.high)
    assert sorted(map(key, got.collect())) == sorted(map(key, batch.collect()))


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    rows, _ = split_events(spark, tmp_path)
    rows.union(rows).repartitionByRange(2, "ts").write.parquet(f"{tmp_path}/twice")
    stream = S.event_stream(spark, f"{tmp_path}/twice", rows.schema, 100)
    assert drain(S.first_seen(stream, ["event_id"]), "once", "append").count() == rows.select("event_id").distinct().count()


def test_recent_texts_are_marked(spark, tmp_path):
    turns = [(1, i, t) for i, t in enumerate("a b a c d b".split())] + [(2, 0, "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(f"{tmp_path}/turns")
    stream = spark.readStream.schema("conv_id long, turn long, text string").parquet(f"{tmp_path}/turns")
    got = {(r.conv_id, r.turn): r.repeated for r in drain(S.recent_repeats(stream, 3), "recent", "append").collect()}
    assert got == {(1, 0): False, (1, 1): False, (1, 2): True, (1, 3): False, (1, 4): False, (1, 5): False, (2, 0): False}


def test_upserts_keep_the_latest_row(spark, tmp_path):
    for k, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")])):
        spark.createDataFrame(rows, "id long, at long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    schema = "id long, at long, v string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    query = S.upsert(stream, f"{tmp_path}/table", ["id"], "at", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert sorted((r.id, r.v) for r in S.latest(spark, f"{tmp_path}/table", schema).collect()) == [(1, "c"), (2, "b")]
