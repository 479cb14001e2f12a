import pytest

from ratecard.plans import bundles, catalogue, crawls, details, indexes, replays, searches, selections, sorts, streams, wordings  # noqa: F401  (the queries of the others join the catalogue)
from tests.compare import difference
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    assert difference(spark, SF, catalogue.QUERIES[name], catalogue.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
