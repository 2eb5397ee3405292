"""Registered queries against their SQL twins on the smallest tables; set ALL_QUERIES=1 for every one of them."""

import os

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from bench import HEADLINE

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else sorted(set(HEADLINE) & set(entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, con, name):
    ok, note = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "possession_share" in df.columns


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
