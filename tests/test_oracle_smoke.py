"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import hashlib
import json

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF

TABLES = "region nation customer supplier part orders events documents pages conversations".split()
FAST = ["dump_roundtrip", "chunk_by_bytes", "pack_files", "category_sequence", "kind_segments", "renumber",
        "ledger_alignment", "pattern_evidence", "script_classes", "snapshot_replay"]


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted(json.dumps([str(r[i]) for i in order]) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0
