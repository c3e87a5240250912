"""Queue and streaming queries; each streaming one is checked against its batch SQL."""

from pyspark.sql import functions as F

from tablewright.plans.grouping import RATES, counters
from tablewright.plans.registry import query
from tablewright.sources import readers
from tablewright.storage import work_path
from tablewright.streaming import queues, streams

MSG_SQL = """m AS (SELECT 'events' AS topic, event_id % 6 AS partition, user_id::VARCHAR AS key, props AS value, ts AS timestamp,
  row_number() OVER (PARTITION BY event_id % 6 ORDER BY event_id) - 1 AS "offset" FROM events)"""


def messages(t):
    return queues.as_messages(t.events, F.col("event_id") % 6, "event_id", F.col("user_id").cast("string"), F.col("props"), "ts")


@query("read_messages", f"""WITH {MSG_SQL} SELECT partition, "offset", key, value FROM m WHERE partition = 3 AND "offset" >= 50 ORDER BY "offset" LIMIT 400""")
def read_messages(t):
    return readers.peek_messages(messages(t), 400, 3, 50).select("partition", "offset", "key", "value")


@query("stream_positions", f"""WITH {MSG_SQL} SELECT 'earliest' AS start, count(*) AS n FROM m
UNION ALL SELECT 'latest', 0 UNION ALL SELECT 'timestamp', count(*) FROM m WHERE timestamp >= TIMESTAMP '2024-01-20'
UNION ALL SELECT 'offset', count(*) FROM m WHERE "offset" >= 1000""")
def stream_positions(t):
    m = messages(t)
    starts = {"earliest": None, "latest": None, "timestamp": "2024-01-20 00:00:00", "offset": 1000}
    parts = [queues.from_position(m, p, v).agg(F.count("*").alias("n")).select(F.lit(p).alias("start"), "n") for p, v in starts.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("stream_query_time", f"""WITH {MSG_SQL} SELECT partition, "offset", key FROM m WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'
ORDER BY timestamp, partition, "offset" LIMIT 1000""")
def stream_query_time(t):
    return queues.query_time(messages(t), "2024-01-05 00:00:00", "2024-01-09 00:00:00", 1000).select("partition", "offset", "key")


@query("stream_query_key", f"""WITH {MSG_SQL} SELECT partition, "offset", value FROM m WHERE key = '7'""")
def stream_query_key(t):
    return queues.query_key(messages(t), "7").select("partition", "offset", "value")


@query("stream_backlog", f"""WITH {MSG_SQL},
e AS (SELECT topic, partition, max("offset") + 1 AS end_offset FROM m WHERE partition <> 5 GROUP BY ALL),
c AS (SELECT value AS grp, topic, partition, max("offset") + 1 AS committed FROM m GROUP BY ALL)
SELECT grp AS "group", topic, sum(greatest(0, coalesce(end_offset, 0) - committed))::BIGINT AS backlog FROM c LEFT JOIN e USING (topic, partition) GROUP BY ALL""")
def stream_backlog(t):
    m = messages(t)
    commits = m.groupBy(F.col("value").alias("group"), "topic", "partition").agg((F.max("offset") + 1).alias("committed"))
    return queues.backlog(commits, queues.end_offsets(m.where("partition <> 5")))


@query("stream_lag_ms", """
WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN epoch_us(ts) // 1000 END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) // 1000 - 1000 END AS c, epoch_us(ts) // 1000 - 5000 AS d FROM events),
l AS (SELECT coalesce(a, c, d) AS l FROM s)
SELECT coalesce(max(1705000000000 - l), 0) AS lag_ms FROM l WHERE l > 0 AND l <= 1705000000000""")
def stream_lag_ms(t):
    ms = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', ts)"
    subs = t.events.selectExpr(f"CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN {ms} END AS last_acked",
                               f"CASE WHEN event_id % 5 <> 0 THEN {ms} - 1000 END AS last_consumed", f"{ms} - 5000 AS last_mark_delete")
    return queues.lag_ms(subs, 1705000000000)


@query("stream_partition_overview", """
WITH p AS (SELECT event_id % 500 AS partition, min(event_id) AS b, max(event_id) AS e, CASE WHEN event_id % 500 % 13 = 0 THEN -1 ELSE event_id % 500 % 3 END AS leader, event_id % 500 % 7 = 0 AS under FROM events GROUP BY ALL)
SELECT count(*) AS partitions, sum(e - b)::BIGINT AS messages, sum(b)::BIGINT AS begin_offsets, sum(e)::BIGINT AS end_offsets,
  count(DISTINCT leader) FILTER (leader >= 0) AS leaders, count(*) FILTER (under) AS under_replicated, count(*) FILTER (leader < 0) AS offline, count(*) FILTER (leader >= 0 AND NOT under) AS healthy FROM p""")
def stream_partition_overview(t):
    p = t.events.groupBy((F.col("event_id") % 500).alias("partition")).agg(F.min("event_id").alias("begin_offset"), F.max("event_id").alias("end_offset"))
    p = p.withColumns({
        "leader": F.when(F.col("partition") % 13 == 0, -1).otherwise(F.col("partition") % 3),
        "replicas": F.array(F.lit(0), F.lit(1), F.lit(2)),
        "in_sync": F.when(F.col("partition") % 7 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2))),
    })
    return queues.partition_overview(p)


@query("stream_retention", f"""WITH {MSG_SQL} SELECT partition, "offset" FROM m WHERE timestamp >= (SELECT max(timestamp) FROM m) - INTERVAL 10080 MINUTE""")
def stream_retention(t):
    return queues.retention(messages(t), 10080).select("partition", "offset")


@query("stream_retention_size", f"""WITH {MSG_SQL},
s AS (SELECT *, sum(octet_length(encode(key)) + octet_length(encode(value))) OVER (PARTITION BY partition ORDER BY "offset" DESC) AS bytes FROM m)
SELECT partition, "offset" FROM s WHERE bytes <= 1048 AND timestamp >= (SELECT max(timestamp) FROM s WHERE bytes <= 1048) - INTERVAL 20000 MINUTE""")
def stream_retention_size(t):
    return queues.retention(messages(t), 20000, megabytes=0.001).select("partition", "offset")


def event_stream(t):
    return streams.read_files(t.spark, t.path, t.events.schema, "events.parquet")


@query("stream_rate", RATES)
def stream_rate(t):
    live = event_stream(t).selectExpr(
        "event_id", "event_type", "ts", "CAST(event_id * 3 - CASE WHEN event_id % 40 = 0 THEN 100000 ELSE 0 END AS DOUBLE) AS counter")
    assert live.columns == counters(t).columns
    out = work_path(t.spark, "rate")
    streams.finish(streams.stream_rate(live, out, ["event_type"], "ts", "counter", ["ts", "event_id"], f"{out}/checkpoint"))
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "event_type", "counter", F.round("rate", 9).alias("rate"))


@query("stream_recent", """
SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 60""")
def stream_recent(t):
    out = work_path(t.spark, "recent")
    live = event_stream(t).select("event_id", "event_type", "ts", "value")
    streams.finish(streams.stream_recent(live, out, ["event_type"], ["ts", "event_id"], f"{out}/checkpoint"))
    return streams.read_state(t.spark, out).select("event_id", "event_type", "value")


@query("stream_upsert_sink", """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(event_type, c_mktsegment) AS event_type, coalesce(value, c_acctbal) AS value FROM customer LEFT JOIN last ON c_custkey = user_id
UNION ALL SELECT user_id, event_type, value FROM last WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def stream_upsert_sink(t):
    out = work_path(t.spark, "upsert")
    live = event_stream(t).select("user_id", "event_type", "value", "event_id")
    streams.finish(streams.stream_upsert_sink(live, out, ["user_id"], "event_id", f"{out}/checkpoint"))
    base = t.customer.selectExpr("c_custkey AS user_id", "c_mktsegment AS event_type", "c_acctbal AS value")
    target = base.withColumn("event_id", F.lit(None).cast("bigint"))
    found = streams.read_upserted(t.spark, out, ["user_id"], target, sequence="event_id")
    return found.select("user_id", "event_type", "value")


WINDOWS = """SELECT strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"""


def shown(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_counts_window", WINDOWS)
def stream_counts_window(t):
    return shown(queues_counts(t.events))


def queues_counts(events):
    return streams.counts_per_window(events, "ts", ["event_type"], "10 minutes")


@query("stream_counts_live", WINDOWS)
def stream_counts_live(t):
    out = work_path(t.spark, "counts")
    live = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    streams.finish(streams.stream_counts_window(live, out, "ts", ["event_type"], f"{out}/checkpoint", "10 minutes"))
    found = streams.read_upserted(t.spark, out, ["window_start", "event_type"], sequence="n")
    return shown(found.select("window_start", "event_type", "n"))
