"""Sources and sinks (A01-A03, A09-A13): round trips and metadata."""

from __future__ import annotations

import json
import uuid

import pytest

from tessera.sources import io


def test_parquet_and_csv_round_trip(spark):
    df = spark.createDataFrame([("00001", 1.5), ("00002", 2.5)], "county_fips string, v double")
    base = io.scratch_path(spark, "t-" + uuid.uuid4().hex[:6])
    io.save_data(df, base + "/x.parquet")
    io.save_data(df, base + "/x.csv")
    assert sorted(io.load_saved_data(spark, base + "/x.parquet").collect()) == sorted(df.collect())
    back = io.load_saved_data(spark, base + "/x.csv", schema="county_fips string, v double")
    assert sorted(back.collect()) == sorted(df.collect())  # FIPS keep their leading zeros
    with pytest.raises(ValueError):
        io.load_saved_data(spark, base + "/x.xlsx")


def test_metadata_sidecar(spark):
    df = spark.createDataFrame([("00001", 1.5), ("00001", 2.5), ("00003", 1.0)], "county_fips string, v double")
    base = io.scratch_path(spark, "m-" + uuid.uuid4().hex[:6])
    meta = io.save_processed_data(df, base + "/y.parquet", {"stage": "spatial"}, distinct_col="county_fips")
    assert meta["record_count"] == 3 and meta["unique_county_fips"] == 2 and meta["stage"] == "spatial"
    side = json.loads(spark.read.text(base + "/y.parquet.metadata.json").first()[0])
    assert side["columns"] == ["county_fips", "v"]
