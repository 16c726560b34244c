"""Every registered query runs, and agrees with its SQL oracle where it has one."""

import os

import pytest

import __spark_entry__ as entry
import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return check.oracle(SF_DIR)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    rows, problem = check.compare(spark, db, name, SF_DIR)
    assert not problem
    assert rows > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
