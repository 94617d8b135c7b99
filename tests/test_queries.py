"""Every query of the recognition dataflow against its SQL, or for rows where there is none."""

import pytest

from glyphmill.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys() - {"ocr_e2e"}))
def test_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count()


def test_contract():
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count()
