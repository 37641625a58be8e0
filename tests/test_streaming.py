from datetime import datetime, timedelta

from kinolake.operators.tables import Store
from kinolake.streaming.ingest import deduplicated, incremental_ingest, sessions, stream_parquet, tumbling_counts, with_event_time


def events(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=37 * i), i % 3, "a" if i % 2 else "b", float(i)) for i in range(200)] + [(5, start, 2, "a", 1.0)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_incremental_ingest(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id string, content string"
    store = Store(spark, str(tmp_path / "tables"))
    spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "0"), (None, "x")], schema).write.parquet(source)
    for _ in range(2):
        incremental_ingest(stream_parquet(spark, source, schema), store, "t", "id", str(tmp_path / "cp")).awaitTermination()
        assert sorted((r.id, r.content) for r in store.read("t").collect()) == [("a", "1"), ("b", "2")]
    spark.createDataFrame([("b", "9"), ("c", "3")], schema).write.mode("append").parquet(source)
    incremental_ingest(stream_parquet(spark, source, schema), store, "t", "id", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.id, r.content) for r in store.read("t").collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_windows_on_stream_equal_batch_for_closed_windows(spark, tmp_path):
    source = str(tmp_path / "events")
    batch = events(spark)
    batch.write.parquet(source)
    stream = tumbling_counts(with_event_time(stream_parquet(spark, source, batch.schema)))
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(r.window_start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.event_type): r.n for r in tumbling_counts(batch).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 2


def test_sessions_and_dedup(spark):
    df = events(spark)
    assert deduplicated(df).count() == 200
    rows = sessions(df, gap="2 hours").collect()
    assert sum(r.n for r in rows) == 201
    assert tumbling_counts(df.limit(0)).count() == 0
