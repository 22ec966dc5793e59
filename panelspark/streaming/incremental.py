"""Append-only logs read as streams: last-wins state and ledger rollups, kept in Spark's own state store.

State lies in RocksDB below the checkpoint of the stream, one row for each key, whatever the number of batches. A batch
that runs again after a failure starts from the state of the batch before it, so nothing is counted twice. State is read
with Spark's state source; closed windows of a rollup are in the file sink, which commits each batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Start on what is available, with state in RocksDB; the session's own setting stays as it is."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def last_wins_stream(
    stream: DataFrame, keys: Sequence[str], seq: str, checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep the version with the highest sequence of every key of an append-only log.

    Order of arrival doesn't matter, repeated rows change nothing, and of rows with one key and sequence the one with the
    greatest other columns stays. `changed` gets each batch's changed keys (and its number) and has to read them all; the state is read with
    current_state.
    """
    rest = [c for c in stream.columns if c not in (*keys, seq)]
    last = stream.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("last")).select(*keys, "last.*")
    writer = last.writeStream.outputMode("update")
    return _start(stream.sparkSession, writer.foreachBatch(changed) if changed else writer.format("noop"), checkpoint)


def current_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Last version of every key after the last finished batch."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value.max").alias("_last")).select("*", "_last.*").drop("_last")


def ledger_stream(
    stream: DataFrame, ts: str, group: Sequence[str], sums: dict[str, Column], window: str, watermark: str,
    unique: Sequence[str] = (),
) -> DataFrame:
    """Event-time rollup of a ledger: start, group, n and sums (as double or bigint) for each window.

    Rows later than the watermark are left out. Of rows equal in `unique` that come within the watermark, one counts.
    """
    stream = stream.withWatermark(ts, watermark)
    if unique:
        stream = stream.dropDuplicatesWithinWatermark(list(unique))
    return (
        stream.groupBy(F.window(ts, window).alias("_w"), *group)
        .agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
        .select(F.col("_w.start").alias("start"), *group, "n", *sums)
    )


def run_rollup(rolled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window to `path` once the watermark has passed it; open windows are state."""
    return _start(rolled.sparkSession, rolled.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)


def rollup_state(spark: SparkSession, path: str, checkpoint: str, schema: str) -> DataFrame:
    """All windows after the last finished batch: the closed ones from the sink, the open ones from the state.

    schema: the columns of the rollup, start first, then group, n and sums (bigint or double).
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    closed = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    ids = spark.read.format("state-metadata").load(checkpoint).where("operatorName = 'stateStoreSave'")
    state = spark.read.format("statestore").option("operatorId", ids.first().operatorId).load(checkpoint)
    names = closed.columns
    sums = names[names.index("n"):]
    kinds = {f.name: f.dataType.simpleString() for f in closed.schema.fields}
    buffers = F.col("value").cast("struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in sums) + ">")
    group = names[1:names.index("n")]
    opened = state.select(F.col("key").getItem("window").getItem("start").alias("start"), *[F.col(f"key.{g}") for g in group], buffers.alias("_v"))
    return closed.unionByName(opened.select("start", *group, "_v.*"))
