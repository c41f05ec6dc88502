"""Every registered query against its SQL twin on the shared tables."""

import pytest

from catalograph.plans.catalogue import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_matches_sql(spark, sf, con, key):
    ok, message, rows, _ = compare(spark, con, sf, QUERIES[key], ORACLES.get(key))
    assert ok, message


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_answers(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key_id", "iri", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
