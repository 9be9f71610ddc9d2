"""Spark session defaults and shared helpers for lineage and size checks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count a side may have to be broadcast.  The bound is checked
# with an aggregate before the hint is applied; above it the plain shuffle
# join is used and AQE may still convert it at runtime.
BROADCAST_MAX_ROWS = 2_000_000
# Largest size of a persisted side; rows may be wide (polygon rings).
BROADCAST_MAX_BYTES = 256 << 20


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "tessera") -> SparkSession:
    """Session with the settings the engine relies on.

    ANSI mode stays on (Spark default); every ratio uses ``try_divide``.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it a cluster's executors could not see what the driver
    names, so that is an error.  Local sessions get a fresh folder under /tmp.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table written into the shared checkpoint folder and read again.

    A checkpoint would cut the lineage as well, but keeps the size that the optimizer guessed for the plan; over rounds
    of joins these guesses multiply without bound.  A table has its real size.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *cols: str, rows: int) -> DataFrame:
    """``df`` (a written table) by ``cols`` in tasks of about ``rows`` rows: by bytes, as Spark sizes its tasks, a table of
    few bytes is one task, however much work each row makes."""
    return df.repartition(max(1, -(-df.count() // rows)), *cols)


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven under ``max_rows``.

    Used for dimension-like sides (stations, counties, polygon cells) whose
    size does not grow with the fact table.  Callers persist ``df`` first
    when it is derived, so the count does not add a second computation.
    """
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        # the count fills the cache, after which the plan's size is the measured one
        small = df.count() <= max_rows and int(
            str(df._jdf.queryExecution().withCachedData().stats().sizeInBytes())) <= BROADCAST_MAX_BYTES
    else:
        small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
