"""Queue measures over message, commit and partition frames (batch or stream)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.aggregates import rank_in_group
from tablewright.operators.segments import running


def as_messages(
    df: DataFrame, partition: Column, order: str, key: Column, value: Column, at: str, topic: str = "events"
) -> DataFrame:
    """A table as queue messages: ``topic, partition, offset, key, value, timestamp``."""
    rows = df.select(
        F.lit(topic).alias("topic"), partition.alias("partition"), key.alias("key"),
        value.alias("value"), F.col(at).alias("timestamp"), F.col(order).alias("_order"),
    )
    return rank_in_group(rows, ["partition"], ["_order"], "offset").drop("_order")


def from_position(df: DataFrame, position: str, value: Any = None) -> DataFrame:
    """Messages from ``earliest``, ``latest`` (nothing yet), a ``timestamp`` or an ``offset``."""
    if position == "earliest":
        return df
    if position == "latest":
        return df.where(F.lit(False))
    if position == "timestamp":
        return df.where(F.col("timestamp") >= F.lit(value).cast(df.schema["timestamp"].dataType))
    if position == "offset":
        return df.where(F.col("offset") >= F.lit(value))
    raise ValueError(f"unknown position {position}")


def query_time(df: DataFrame, begin: Any, end: Any, limit: int | None = None) -> DataFrame:
    kind = df.schema["timestamp"].dataType
    found = df.where(F.col("timestamp").between(F.lit(begin).cast(kind), F.lit(end).cast(kind)))
    return _first(found, limit)


def query_key(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    return _first(df.where(F.col("key") == key), limit)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy("timestamp", "partition", "offset").limit(limit)


def end_offsets(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def backlog(commits: DataFrame, ends: DataFrame) -> DataFrame:
    """Per group and topic: the sum over partitions of ``max(0, end - committed)``; an
    unknown end offset counts 0."""
    joined = commits.join(ends, ["topic", "partition"], "left")
    lag = F.greatest(F.lit(0), F.coalesce("end_offset", F.lit(0)) - F.col("committed"))
    return joined.groupBy("group", "topic").agg(F.sum(lag).alias("backlog"))


def lag_ms(subscriptions: DataFrame, now_ms: int) -> DataFrame:
    """Greatest ``now`` minus last acknowledged time in milliseconds over the
    subscriptions; a missing time is replaced by the consumed, then the mark-delete
    one. A time that is zero or in the future counts as no lag; without any it is 0."""
    last = F.coalesce("last_acked", "last_consumed", "last_mark_delete")
    lag = F.when((last > 0) & (last <= now_ms), F.lit(now_ms) - last)
    return subscriptions.agg(F.coalesce(F.max(lag), F.lit(0)).alias("lag_ms"))


def partition_overview(partitions: DataFrame) -> DataFrame:
    """Totals over a topic's partitions ``(partition, begin_offset, end_offset, leader,
    replicas, in_sync)``."""
    offline = F.col("leader").isNull() | (F.col("leader") < 0)
    under = F.size("in_sync") < F.size("replicas")
    return partitions.agg(
        F.count("*").alias("partitions"),
        F.sum(F.greatest(F.lit(0), F.col("end_offset") - F.col("begin_offset"))).alias("messages"),
        F.sum("begin_offset").alias("begin_offsets"), F.sum("end_offset").alias("end_offsets"),
        F.countDistinct(F.when(~offline, F.col("leader"))).alias("leaders"),
        F.count_if(under).alias("under_replicated"), F.count_if(offline).alias("offline"),
        F.count_if(~offline & ~under).alias("healthy"),
    )


def retained_bytes(df: DataFrame, megabytes: float, segments: int | None = None) -> DataFrame:
    """The newest messages of each partition, up to ``megabytes`` of keys and values in all
    (-1 keeps all). The running sum from the newest back cuts a great partition into
    segments, so none is whole in a task."""
    if megabytes < 0:
        return df
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    back = df.withColumn("_back", -F.col("offset"))
    summed = running(back, ["topic", "partition"], ["_back"], {"_bytes": ("sum", size)}, segments)
    return summed.where(F.col("_bytes") <= F.lit(int(megabytes * 1024 * 1024))).drop("_back", "_bytes")


def retention(df: DataFrame, minutes: int, newest: Any = None, megabytes: float = -1) -> DataFrame:
    """Messages not older than ``minutes`` before the newest and within the newest
    ``megabytes`` of their partition; -1 sets no bound."""
    df = retained_bytes(df, megabytes)
    if minutes < 0:
        return df
    if newest is None:
        newest = df.agg(F.max("timestamp").cast("string")).first()[0]
    cut = F.timestamp_add("MINUTE", F.lit(-minutes), F.lit(newest).cast(df.schema["timestamp"].dataType))
    return df.where(F.col("timestamp") >= cut)
