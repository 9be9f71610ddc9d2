"""W05 as a Structured Streaming job.

Events stream in from a Parquet folder (file source, schema from the
batch read), a file a micro-batch.  Each micro-batch writes counts and
sums of its own rows by hourly tumbling window and event type into a
folder of its own (written anew if the batch is run again); they are
added up on read.  The input is bounded, so there is no watermark: files
may come in any order of time, and no row is late.  ``availableNow``
processes everything present and stops, and the job restarts from its
checkpoint after executor or driver loss.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_sums(rows: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Rows, values and sum of values by hourly tumbling window and key.

    Windows need TIMESTAMP; the Parquet column is TIMESTAMP_NTZ, so it is
    read as UTC and the window start cast back."""
    return (rows.withColumn(ts, F.col(ts).cast("timestamp")).groupBy(F.window(ts, "1 hour").alias("w"), key)
            .agg(F.count(F.lit(1)).alias("events"), F.count(value).alias("n_values"), F.sum(value).alias("total"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "events", "n_values", "total"))


def added_up(sums: DataFrame, key: str = "event_type") -> DataFrame:
    """Count and mean value by window and key from any number of partial sums."""
    return (sums.groupBy("window_start", key)
            .agg(F.sum("events").alias("events"), F.try_divide(F.sum("total"), F.sum("n_values")).alias("avg_value")))


def hourly_window_counts(rows: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Hourly tumbling-window count and mean value of a batch."""
    return added_up(window_sums(rows, ts, key, value), key)


def run_hourly_stream(spark: SparkSession, source_glob: str, out_dir: str, checkpoint_dir: str) -> DataFrame:
    """Run the stream over the files matching ``source_glob`` with
    ``availableNow`` and return every window's count and mean.  The query
    can restart from ``checkpoint_dir``."""
    schema = spark.read.parquet(source_glob).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source_glob)

    def sink(batch: DataFrame, batch_id: int) -> None:
        window_sums(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    q = (src.writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return added_up(spark.read.parquet(out_dir))


def stream_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Output and checkpoint folders under the session's checkpoint dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    root = os.path.join(base, "streams", name)
    return os.path.join(root, "out"), os.path.join(root, "checkpoint")
