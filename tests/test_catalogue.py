"""Every catalogue query beside its SQL."""

import harness
import pytest

from changeset.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    if name in catalogue.ORACLES:
        assert harness.compare(spark, db, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) is None
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(catalogue.QUERIES)
    assert entry.entry(spark).count() > 0
