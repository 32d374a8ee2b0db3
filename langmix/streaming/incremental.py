"""Incremental scoring of newly arrived files (Structured Streaming).

The reference skips inputs whose output already exists.  Here the input folder
is a file stream; the streaming checkpoint records which files were consumed,
so every file is scored exactly once, and each micro-batch is written to its
own ``batch_id`` folder with overwrite (a replayed batch replaces its own
output - idempotent).  All folders live under the session's shared
``spark.checkpoint.dir``.

Two forms keep a result current while files arrive: :func:`run_counts` holds keyed
counts in Spark's state store, and partial sums written by :func:`run_incremental`
merge in :func:`merged_means`.  Either survives a restart from its checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langmix.session import ensure_checkpoint_dir


def stream_folder(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/langmix-stream/{name}-{uuid.uuid4().hex[:12]}"


def run_incremental(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                    transform, files_per_trigger: int = 2) -> None:
    """Consume every file under ``source`` once and write ``transform(batch)``
    to ``sink/batch_id=<id>``; returns when all available files are done."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
         .writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch_id")


def run_counts(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, rows_of, keys,
               files_per_trigger: int = 2) -> None:
    """Stateful: counts of ``rows_of(stream)`` by ``keys``, kept in the state store over
    batches and restarts; each batch leaves a whole snapshot ``sink/batch_id=<id>``,
    which a replay of the batch overwrites."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (rows_of(stream).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete")
         .foreachBatch(snapshot).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """The last snapshot of :func:`run_counts`."""
    every = spark.read.parquet(sink)
    return every.where(F.col("batch_id") == every.agg(F.max("batch_id")).scalar()).drop("batch_id")


def partial_means(df: DataFrame, keys, values) -> DataFrame:
    """What a batch adds to means by group: (keys, n_<v>, s_<v>) of each value."""
    return df.groupBy(*keys).agg(*[f(v).alias(f"{p}_{v}") for v in values for p, f in (("n", F.count), ("s", F.sum))])


def merged_means(partials: DataFrame, keys, values) -> DataFrame:
    """Means by group from the partial sums of all batches."""
    total = partials.groupBy(*keys).agg(*[F.sum(f"{p}_{v}").alias(f"{p}_{v}") for v in values for p in "ns"])
    return total.select(*keys, *[F.try_divide(F.col(f"s_{v}"), F.col(f"n_{v}")).alias(v) for v in values])


def manifest_anti_join(inputs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """S13 (batch form): inputs whose key is not yet in the manifest of outputs."""
    return inputs.join(manifest.select(key).distinct(), key, "left_anti")
