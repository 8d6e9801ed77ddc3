"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from spanloom.plans.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(name, spark, sf_dir, duck):
    cursor = duck.execute(SQL[name])
    cols = {c[0]: TYPES[str(c[1])] for c in cursor.description}
    expected = cursor.fetchall()
    df = contract.queries()[name](spark, sf_dir)
    assert dict(df.dtypes) == cols
    key = lambda row: tuple((x is not None, x) for x in row)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert expected


def test_entry(spark):
    if not os.path.isdir(contract.SMOKE_DIR):
        pytest.skip("no test tables")
    rows = contract.entry(spark).collect()
    assert {r.type for r in rows} == {"T0", "T1", "T2", "overall"}


def test_no_cross_joins_or_unbounded_broadcasts(spark, sf_dir):
    """No plan pairs rows without a key, and only tables of bounded size are broadcast."""
    for name in ("flat_select", "span_tree", "filter_flat", "prf_report", "confusion_cooccur", "cohesion_ratio"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "BroadcastHashJoin" not in plan


def test_documents_scan_reads_two_columns(spark, sf_dir):
    plan = contract.queries()["prf_report"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "n_chars" not in plan
