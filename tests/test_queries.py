"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest
from oracle import connect, difference

from tallyspan.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, db, name):
    assert difference(QUERIES[name](spark, small), ORACLES[name], db) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, small, name):
    rows = QUERIES[name](spark, small)
    assert len(set(rows.columns)) == len(rows.columns)
    assert rows.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["example_id", "claim_no", "evidence_no", "record_id"]
