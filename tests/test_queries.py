"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle_check import compare, connect

from laplens.plans import ORACLES, QUERIES, flagship

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_flagship_has_rows(spark):
    assert flagship(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], ORACLES[name]) is None
    spark.catalog.clearCache()


def test_refresh_stores_every_step(spark, tmp_path):
    from laplens.plans.jobs import refresh

    counts = refresh(spark, FOLDER, str(tmp_path))
    assert all(c["written"] > 0 and c["failed"] == 0 for c in counts.values())
    assert {p.name for p in tmp_path.iterdir()} == set(counts)
