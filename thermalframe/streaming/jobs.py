"""Streams over files or a broker topic.

Sinks are written per micro-batch into a folder named by the batch number, so a
batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from thermalframe.operators import blocks, drift
from thermalframe.operators.messages import parse_messages, retained_latest
from thermalframe.operators.models import Bundle, predict_all
from thermalframe.session import cut_lineage


FILES_PER_BATCH = 64


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Rows of a file, or of the files in a folder, at most ``files_per_batch`` of them in one micro-batch.

    A plain path must be a folder for a stream; as a pattern that matches itself alone it may be either.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    path = path.rstrip("/")
    return reader.load(path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]")


def broker_stream(spark: SparkSession, servers: str, topics: str, **options) -> DataFrame:
    """(topic, payload, ts) from a Kafka-compatible broker; needs its connector on the class path."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribePattern", topics).options(**options).load())
    return raw.select("topic", F.col("value").alias("payload"), F.col("timestamp").alias("ts"))


def run(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append",
        available_now: bool = True, every: str = "10 seconds") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def drain(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None],
          mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop."""
    query = run(stream, checkpoint, batch, mode)
    query.awaitTermination()
    return query


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def parse_to(path: str) -> Callable[[DataFrame, int], None]:
    """Sink with a dead-letter branch: one write, partitioned into ``branch=good`` and ``branch=dead``."""
    def write(rows: DataFrame, batch_id: int) -> None:
        parsed = parse_messages(rows)
        branch = F.when(F.col("valid"), "good").otherwise("dead")
        (parsed.withColumn("reason", F.when(~F.col("valid"), F.lit("invalid JSON"))).withColumn("branch", branch)
         .drop("valid").write.mode("overwrite").partitionBy("branch").parquet(f"{path}/batch={batch_id}"))
    return write


def score(stream: DataFrame, bundle: Bundle, features: Sequence[str]) -> DataFrame:
    """Stateless scoring of a stream."""
    return predict_all(stream, bundle, features)


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before left at ``path``; None for the first. A missing table is an error, not a fresh start."""
    return spark.read.parquet(f"{path}/batch={batch_id - 1}") if batch_id else None


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Deletes what a batch left that no repeated batch can ask for any more."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def count_rows_to(path: str, order: str, unit: str) -> Callable[[DataFrame, int], None]:
    """Sink that adds ``time_index``, the running sample number per unit over the whole stream, and writes to ``path/rows``.

    A micro-batch is numbered by blocks of rows, so a busy unit spreads over tasks; only the totals per unit pass from
    one batch to the next, as a table at ``path/totals``. A batch that is run again reads the same totals.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        new = cut_lineage(rows)
        before = _before(spark, f"{path}/totals", batch_id)
        if before is None:
            before = spark.createDataFrame([], T.StructType([rows.schema[unit], T.StructField("__before", T.LongType())]))
        before = before.withColumnRenamed(unit, "__unit")
        numbered = blocks.row_index(new, order, [unit]).join(before, F.col(unit).eqNullSafe(F.col("__unit")), "left")
        index = (F.col("time_index") + F.coalesce("__before", F.lit(0))).cast("bigint")
        numbered.select(*rows.columns, index.alias("time_index")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        counts = new.groupBy(F.col(unit).alias("__unit")).agg(F.count(F.lit(1)).alias("__before"))
        (before.unionByName(counts).groupBy(F.col("__unit").alias(unit)).agg(F.sum("__before").alias("__before"))
         .write.mode("overwrite").parquet(f"{path}/totals/batch={batch_id}"))
        _forget(spark, f"{path}/totals", batch_id)
    return write


def split_late_to(path: str, ts: str, delay: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes rows to ``path/rows`` by ``branch``: ``good``, ``late`` or ``untimed`` (no time).

    A row is late if its time lies more than ``delay`` before the newest time of all earlier batches, which is the
    engine's watermark before the batch. That time alone is kept between batches, at ``path/seen``.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = _before(spark, f"{path}/seen", batch_id)
        seen = before.first()["seen"] if before is not None else None
        newest = F.lit(seen).cast("timestamp")
        branch = F.when(F.col(ts).isNull(), "untimed").when(F.col(ts) < newest - F.expr(f"interval {delay}"), "late").otherwise("good")
        rows.withColumn("branch", branch).write.mode("overwrite").partitionBy("branch").parquet(f"{path}/rows/batch={batch_id}")
        rows.agg(F.greatest(F.max(ts).cast("timestamp"), newest).alias("seen")).write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")
        _forget(spark, f"{path}/seen", batch_id)
    return write


def latest_retained(stream: DataFrame, tie: str | None = None) -> DataFrame:
    """Newest retained message per topic as a stream aggregation (update or complete mode); ``tie`` decides equal times."""
    return retained_latest(stream, tie=tie)


def windowed_drift(stream: DataFrame, edges: DataFrame, reference: DataFrame, delay: str = "10 minutes",
                   size: str = "1 hour") -> DataFrame:
    """Stability index per hour against a static reference; a window is emitted once the watermark passes it."""
    return drift.drift_by_window(stream.withWatermark("ts", delay), edges, reference, size=size)


def counts_by_window(stream: DataFrame, delay: str, size: str = "1 hour") -> DataFrame:
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"))
            .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "n"))


def dropped_late(query: StreamingQuery) -> int:
    """Rows the stateful operators dropped behind the watermark, as reported by the query's progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
