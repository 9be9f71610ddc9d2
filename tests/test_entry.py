"""Driver contract: entry() runs, every query has a stable schema, oracle
keys are a subset of query keys; a sample of keys matches DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as ent
from tessera.sources.tables import TABLES

SAMPLE = ["h02_aggregate_trips_to_county_level", "b18_quality_report", "g12_point_in_polygon",
          "e08_create_spending_features", "k03_silhouette", "n12_persona_narratives"]


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "total_trips" in df.columns


def test_oracle_keys_subset():
    assert set(ent.oracle_sql()) <= set(ent.queries())


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_duckdb(spark, key):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    sdf = ent.queries()[key](spark, d)
    cols = sorted(sdf.columns)
    srows = _norm([tuple(r[c] for c in cols) for r in sdf.collect()])
    ddf = con.execute(ent.oracle_sql()[key]).df()[cols]
    drows = _norm([tuple(None if (isinstance(x, float) and math.isnan(x)) else x for x in r)
                   for r in ddf.itertuples(index=False)])
    assert len(srows) == len(drows)
    assert srows == drows
