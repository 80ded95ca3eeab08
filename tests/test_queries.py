"""Registered queries against their SQL on the same tables."""

import os
import subprocess
import sys

import oracle
import pytest

import __spark_entry__ as contract
from armspan.plans.catalog import QUERIES
from armspan.plans.oracles import ORACLES

# A sample drawn by partition.
ROWS_ONLY = {"sample_fraction_bernoulli"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    return oracle.connect(sf_dir)


def test_contract_has_every_query():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_the_workloads_do_not_need_the_other_libraries():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, cwd=os.path.dirname(contract.__file__))
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], done.stderr


def test_every_query_has_a_check():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf_dir, tables):
    assert oracle.compare(QUERIES[name](spark, sf_dir), tables, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_gives_rows(name, spark, small_dir):
    assert QUERIES[name](spark, small_dir).count() > 0


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[0] == "CUST_ID" and rows.count() == 1500
