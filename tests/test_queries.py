"""Every registered query against its SQL on the smallest data, and the contract itself."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def canonical(frame):
    cell = lambda v: "" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_every_query_has_sql_or_is_known_to_have_none():
    without = {"bootstrap_interval", "binomial_test"}
    assert {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"} - set(ORACLE) == without


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_of_queries(spark):
    boot = entry.queries()["bootstrap_interval"](spark, FOLDER).first()
    assert boot.ci_low <= boot.difference <= boot.ci_high
    assert all(0 <= r.p <= 1 for r in entry.queries()["binomial_test"](spark, FOLDER).collect())
