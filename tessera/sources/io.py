"""Sources and sinks.

Readers pick the format from the file suffix; writers use the DataFrame
writer and add a one-row JSON metadata sidecar whose record count comes
from an ``Observation`` collected during the same write (the data is
scanned once).
"""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def load_saved_data(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV (header) or Parquet by extension; other suffixes raise."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith(".parquet"):
        return reader.parquet(path)
    if path.endswith(".csv"):
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    raise ValueError(f"unsupported file type: {path}")


def save_data(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write CSV (with header) or Parquet by extension."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    return path


def save_processed_data(df: DataFrame, path: str, metadata: dict | None = None,
                        distinct_col: str | None = None) -> dict:
    """Data plus ``<path>.metadata.json`` with timestamp,
    record count, columns, optional distinct count and caller metadata."""
    obs = Observation("save")
    exprs = [F.count(F.lit(1)).alias("records")]
    observed = df.observe(obs, *exprs)
    save_data(observed, path)
    meta = {
        "timestamp": datetime.now(timezone.utc).isoformat(),
        "record_count": int(obs.get["records"]),
        "columns": df.columns,
    }
    if distinct_col:
        meta[f"unique_{distinct_col}"] = df.select(F.count_distinct(distinct_col)).first()[0]
    meta.update(metadata or {})
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path + ".metadata.json")
    return meta


def export_json(df: DataFrame, path: str) -> str:
    """Nested records as JSON lines (one file set per table)."""
    df.write.mode("overwrite").json(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the session's checkpoint directory (shared storage
    on a cluster) for exports made by registered queries and tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return os.path.join(base, "exports", name)
