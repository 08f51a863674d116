"""Every registered query against its SQL on DuckDB; tools/check.py does the same on larger tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tabcal.catalog import load_registry

SF = os.environ.get("TABCAL_TEST_SF", "/root/testdata/sf0.001")
# One row id occurs twice in the smallest tables; these queries need unique ids and run on the next size.
UNIQUE_SF = os.environ.get("TABCAL_TEST_SF", "/root/testdata/sf0.01")
UNIQUE_IDS = {
    "append_lineage_j4", "coverage_curve_c15", "interval_methods_c15", "missing_before_after_a5", "readiness_audit_a19",
    "reattach_key_j6", "residual_bootstrap_c13",
}


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in {SF, UNIQUE_SF}:
        found[folder] = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            found[folder].execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return found


def canonical(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in load_registry().items() if sql))
def test_query_matches_sql(spark, duck, name):
    folder = UNIQUE_SF if name in UNIQUE_IDS else SF
    df = contract.queries()[name](spark, folder)
    cursor = duck[folder].execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
