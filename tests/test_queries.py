"""Every registered query against its SQL twin."""

import pytest
from oracle import compare, connect

from velum.plans.registry import ORACLE, QUERIES

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ok, message = compare(spark, duck, ROOT, name, QUERIES, ORACLE)
    assert ok, message
    assert "types differ" not in message, message
