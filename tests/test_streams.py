"""The streaming forms over eight files equal the batch forms over all rows."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import transfer, windows
from tablewright.streaming import queues, streams


@pytest.fixture(scope="module")
def event_files(spark, tables, tmp_path_factory):
    """Events in time order, one file per slice, so each batch is later than the last."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = tables.events.withColumn("ts", F.col("ts").cast("timestamp"))
    top = events.agg(F.max("event_id")).first()[0] + 1
    for i in range(8):
        part = events.where((F.col("event_id") >= i * top // 8) & (F.col("event_id") < (i + 1) * top // 8))
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def live(spark, files):
    return streams.read_files(spark, files[0], files[1].schema, files_per_trigger=1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rates_go_on_across_batches(spark, event_files, folder):
    counters = lambda df: df.select("event_type", "event_id", "ts", F.col("event_id").cast("double").alias("c"))
    query = streams.stream_rate(counters(live(spark, event_files)), folder, ["event_type"], "ts", "c", ["ts", "event_id"], f"{folder}/ck")
    streams.finish(query)
    got = spark.read.parquet(f"{folder}/rows")
    assert got.select("batch_id").distinct().count() == 8
    want = windows.rate_counters(counters(event_files[1]), ["event_type"], "ts", "c", ["ts", "event_id"])
    shape = lambda df: rows(df.select("event_id", F.round("rate", 9)))
    assert shape(got) == shape(want)


def test_recent_samples(spark, event_files, folder):
    streams.finish(streams.stream_recent(live(spark, event_files), folder, ["event_type"], ["ts", "event_id"], f"{folder}/ck", n=20))
    want = windows.last_n_samples(event_files[1], ["event_type"], ["ts", "event_id"], 20)
    assert rows(streams.read_state(spark, folder).select("event_id")) == rows(want.select("event_id"))


def test_upserts_and_a_repeated_batch(spark, event_files, folder):
    cols = ["user_id", "event_type", "event_id"]
    query = streams.stream_upsert_sink(live(spark, event_files).select(*cols), folder, ["user_id"], "event_id", f"{folder}/ck")
    streams.finish(query)
    got = streams.read_upserted(spark, folder, ["user_id"], sequence="event_id")
    want = transfer.last_per_key(event_files[1].select(*cols), ["user_id"], "event_id")
    assert rows(got.select(*cols)) == rows(want)
    # Nothing new arrives: a second run adds no batch and changes nothing.
    streams.finish(streams.stream_upsert_sink(live(spark, event_files).select(*cols), folder, ["user_id"], "event_id", f"{folder}/ck"))
    assert rows(streams.read_upserted(spark, folder, ["user_id"], sequence="event_id").select(*cols)) == rows(want)


def test_late_rows_do_not_win(spark, tmp_path):
    """Files out of order, one per batch: as the batch result, before and after folding."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 10, "a"), (2, 4, "b")], [(1, 5, "late"), (3, 1, "c")], [(2, 9, "new")], [(3, 0, "late")]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(f"{source}/part={i}")
    frame = spark.read.parquet(source).drop("part")
    for i in range(len(batches)):
        files = streams.read_files(spark, f"{source}/part={i}", frame.schema)
        streams.finish(streams.stream_upsert_sink(files, f"{out}/{i}", ["k"], "seq", f"{out}/ck{i}"))
        got = spark.read.parquet(f"{out}/{i}/rows").drop("batch_id")
        got.write.parquet(f"{out}/all/rows/batch_id={i}")
    want = [(1, 10, "a"), (2, 9, "new"), (3, 1, "c")]
    assert sorted(map(tuple, streams.read_upserted(spark, f"{out}/all", ["k"], sequence="seq").collect())) == want
    streams.compact(spark, f"{out}/all", ["k"], "seq")
    assert sorted(map(tuple, streams.read_upserted(spark, f"{out}/all", ["k"], sequence="seq").collect())) == want
    assert spark.read.parquet(f"{out}/all/rows").select("batch_id").distinct().count() == 2



def test_window_counts(spark, event_files, folder):
    streams.finish(streams.stream_counts_window(live(spark, event_files), folder, "ts", ["event_type"], f"{folder}/ck", "1 hour"))
    got = streams.read_upserted(spark, folder, ["window_start", "event_type"], sequence="n").select("window_start", "event_type", "n")
    want = streams.counts_per_window(event_files[1], "ts", ["event_type"], "1 hour")
    assert rows(got) == rows(want)


def test_positions_and_retention(spark, tables):
    m = queues.as_messages(tables.events, F.col("event_id") % 4, "event_id", F.lit("k"), F.lit("v"), "ts")
    per = m.groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in per)
    assert queues.from_position(m, "latest").count() == 0
    assert queues.retention(m, -1).count() == m.count()
    with pytest.raises(ValueError):
        queues.from_position(m, "middle")


def test_backlog_and_lag(spark):
    commits = spark.createDataFrame([("g", "t", 0, 5), ("g", "t", 1, 9), ("g", "t", 2, 3)], "group string, topic string, partition int, committed bigint")
    ends = spark.createDataFrame([("t", 0, 8), ("t", 1, 7)], "topic string, partition int, end_offset bigint")
    assert [tuple(r) for r in queues.backlog(commits, ends).collect()] == [("g", "t", 3)]
    subs = spark.createDataFrame([(0, 900, 1), (950, 10, 1), (5000, None, None), (0, 0, 0)], "last_acked bigint, last_consumed bigint, last_mark_delete bigint")
    assert queues.lag_ms(subs, 1000).first()["lag_ms"] == 50
    assert queues.lag_ms(subs.limit(0), 1000).first()["lag_ms"] == 0


def test_retention_by_size(spark):
    m = spark.createDataFrame([("t", p, o, None if o % 3 else "kk", "v" * (o % 5)) for p in range(2) for o in range(50)], "topic string, partition int, offset bigint, key string, value string")
    left = lambda df: {(r["partition"], r["offset"]) for r in df.collect()}
    want, bound = set(), 60
    for p in range(2):
        total = 0
        for o in range(49, -1, -1):
            total += (0 if o % 3 else 2) + o % 5
            if total <= bound:
                want.add((p, o))
    assert left(queues.retained_bytes(m, bound / 1024 / 1024)) == want == left(queues.retained_bytes(m, bound / 1024 / 1024, segments=3))
    assert queues.retained_bytes(m, -1).count() == 100 and queues.retained_bytes(m, 0).count() in (0, 2)


def test_a_stopped_compaction_loses_nothing(spark, folder, monkeypatch):
    log = f"{folder}/log"
    for b in range(5):
        spark.createDataFrame([(k, b * 10 + k, b) for k in range(b, b + 3)], "k int, v int, seq int").write.parquet(f"{log}/rows/batch_id={b}")
    want = rows(streams.read_upserted(spark, log, ["k"], sequence="seq"))

    real = streams._folded
    streams.compact(spark, log, ["k"], "seq")
    assert rows(streams.read_upserted(spark, log, ["k"], sequence="seq")) == want
    # A stop after the fold moved in: the old batches are still there beside it.
    for b in range(3):
        spark.createDataFrame([(k, b * 10 + k, b) for k in range(b, b + 3)], "k int, v int, seq int").write.parquet(f"{log}/rows/batch_id={b}")
    assert rows(streams.read_upserted(spark, log, ["k"], sequence="seq")) == want
    # A stop while the fold is written: the next run starts over.
    def stop(*args):
        real(*args).drop("batch_id").write.mode("overwrite").parquet(f"{log}/folded")
        raise RuntimeError("stopped")

    monkeypatch.setattr(streams, "_folded", stop)
    with pytest.raises(RuntimeError):
        streams.compact(spark, log, ["k"], "seq")
    monkeypatch.undo()
    assert rows(streams.read_upserted(spark, log, ["k"], sequence="seq")) == want
    streams.compact(spark, log, ["k"], "seq")
    assert rows(streams.read_upserted(spark, log, ["k"], sequence="seq")) == want


def test_a_stopped_swap_is_finished(spark, folder):
    import os

    from tablewright.sources import writers

    path = f"{folder}/t"
    writers.replace_table(spark.range(3), path)
    writers.replace_table(spark.range(5), path)
    spark.range(7).write.parquet(f"{path}.new")
    os.rename(path, f"{path}.aside")  # the state between the two renames
    if not os.path.exists(f"{path}.old"):
        os.rename(f"{path}.aside", f"{path}.old")
    writers.restore_table(spark, path)
    assert spark.read.parquet(path).count() == 7
