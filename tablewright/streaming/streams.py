"""Continuous forms on Structured Streaming.

Each micro-batch is written below ``batch_id=n`` with overwrite, so a batch run
again after a failure replaces its own output. State that goes from batch to
batch (the last sample of a series, its last 60) is a small table of the same
kind: batch n reads version n-1. The work inside a batch is ordinary DataFrame
code, so a series with a third of all rows is split like in the batch form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.transfer import last_per_key, merge_into
from tablewright.operators.windows import last_n_samples, rate_counters

BATCH = "batch_id"


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
    files_per_trigger: int | None = None, start: Column | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; ``start`` is the first position as a predicate."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    return df if start is None else df.where(start)


def read_topic(spark: SparkSession, servers: str, topic: str, start: str = "latest") -> DataFrame:
    """A Kafka topic from ``earliest``, ``latest``, per-partition JSON offsets, or from a
    time given as ``timestamp:<ms>``."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "includeHeaders": "true"}
    if start.startswith("timestamp:"):
        options["startingTimestamp"] = start.partition(":")[2]
    else:
        options["startingOffsets"] = start
    return spark.readStream.format("kafka").options(**options).load()


def _each_batch(
    stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    available_now: bool = True, interval: str = "10 seconds",
) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def _prune(spark: SparkSession, path: str, batch_id: int, keep: int = 2) -> None:
    """Remove state versions older than the last ``keep``: a batch run again reads the
    one before it, nothing reads older ones."""
    if batch_id < keep:
        return
    jvm = spark.sparkContext._jvm
    gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{BATCH}={batch_id - keep}")
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def _earlier(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{BATCH}={batch_id - 1}")


def stream_rate(
    stream: DataFrame, out: str, series: list[str], at: str, value: str, order: list[str],
    checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Per-second rates of cumulative counters, going on from the last sample each
    series had in earlier batches."""
    schema = stream.schema
    rest = [c for c in stream.columns if c not in series]

    def step(batch: DataFrame, batch_id: int) -> None:
        known = _earlier(batch.sparkSession, f"{out}/state", schema, batch_id)
        both = batch.withColumn("_old", F.lit(False)).unionByName(known.withColumn("_old", F.lit(True)))
        rated = rate_counters(both, series, at, value, order).where("NOT _old").drop("_old")
        _put(rated, f"{out}/rows", batch_id)
        newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
        last = both.groupBy(*series).agg(newest).select(*series, "r.*").select(*stream.columns)
        _put(last, f"{out}/state", batch_id)
        _prune(batch.sparkSession, f"{out}/state", batch_id)

    return _each_batch(stream, step, checkpoint, available_now=available_now)


def stream_recent(
    stream: DataFrame, out: str, series: list[str], order: list[str], checkpoint: str, n: int = 60,
    available_now: bool = True,
) -> StreamingQuery:
    """The newest ``n`` samples per series after every batch."""
    schema = stream.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        known = _earlier(batch.sparkSession, f"{out}/state", schema, batch_id)
        _put(last_n_samples(batch.unionByName(known), series, order, n), f"{out}/state", batch_id)
        _prune(batch.sparkSession, f"{out}/state", batch_id)

    return _each_batch(stream, step, checkpoint, available_now=available_now)


def read_state(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of a state table."""
    all_versions = spark.read.parquet(f"{out}/state")
    newest = all_versions.agg(F.max(BATCH)).first()[0]
    return all_versions.where(F.col(BATCH) == newest).drop(BATCH)


def stream_upsert_sink(
    stream: DataFrame, out: str, keys: list[str], sequence: str | None, checkpoint: str,
    mode: str = "append", available_now: bool = True,
) -> StreamingQuery:
    """Continuous upsert as a log: each batch adds its last row per key, with its
    ``sequence``. Readers take the row of the greatest (sequence, batch) per key, so late
    rows never replace newer ones; ``compact`` folds the log."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _put(last_per_key(batch, keys, sequence), f"{out}/rows", batch_id)

    return _each_batch(stream, step, checkpoint, mode, available_now)


def _folded(log: DataFrame, keys: list[str], sequence: str | None) -> DataFrame:
    stamp = [sequence, BATCH] if sequence else [BATCH]
    rows = log.withColumn("_stamp", F.struct(*stamp))
    return last_per_key(rows, keys, "_stamp").drop("_stamp")


def read_upserted(
    spark: SparkSession, out: str, keys: list[str], base: DataFrame | None = None, sequence: str | None = None
) -> DataFrame:
    """The table after all logged batches, folded by ``sequence`` (without one, by batch)."""
    latest = _folded(spark.read.parquet(f"{out}/rows"), keys, sequence).drop(BATCH)
    return latest if base is None else merge_into(latest, base, keys, "replace", checked=False)


def compact(spark: SparkSession, out: str, keys: list[str], sequence: str | None = None) -> None:
    """Fold all batches but the newest into one, at the place of the newest of them.

    The fold moves into the log in one step, beside the batches that it replaces (its
    folder spells the same number with a leading zero), and only then are these removed.
    Folding twice gives the same rows, so reading is right after a stop at any point. Run
    it while no batch runs."""
    log = spark.read.parquet(f"{out}/rows")
    batches = sorted(r[BATCH] for r in log.select(BATCH).distinct().collect())
    old = batches[:-1]
    if len(old) < 2:
        return
    folded = _folded(log.where(F.col(BATCH) <= old[-1]), keys, sequence).drop(BATCH)
    fresh, name = f"{out}/folded", f"{BATCH}=0{old[-1]}"
    folded.write.mode("overwrite").parquet(fresh)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at(fresh), at(f"{out}/rows/{name}")):
        raise RuntimeError(f"could not put the folded log in place at {out}/rows/{name}")
    for status in fs.listStatus(at(f"{out}/rows")):
        folder = status.getPath().getName()
        if folder.startswith(f"{BATCH}=") and folder != name and int(folder.split("=")[1]) <= old[-1]:
            fs.delete(status.getPath(), True)


def counts_per_window(
    stream: DataFrame, at: str, by: list[str], width: str = "1 minute", late: str | None = None
) -> DataFrame:
    """Counts per key and time window; the same code on a batch and on a stream."""
    rows = stream.withWatermark(at, late) if late and stream.isStreaming else stream
    grouped = rows.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), *by, "n")


def stream_counts_window(
    stream: DataFrame, out: str, at: str, by: list[str], checkpoint: str, width: str = "1 minute",
    late: str = "1 day", available_now: bool = True,
) -> StreamingQuery:
    """Window counts kept current in ``out``: changed windows are logged per batch."""
    counts = counts_per_window(stream, at, by, width, late)
    keys = ["window_start", *by]
    return stream_upsert_sink(counts, out, keys, "n", checkpoint, "update", available_now)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
