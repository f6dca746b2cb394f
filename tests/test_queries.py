"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from seamline.plans.queries import QUERIES
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


#: Pixel arithmetic is too slow in SQL; these are compared with brute force in test_images.py.
NO_TWIN = {"prepare_images", "heuristic_detect", "frame_motion"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, data, name):
    assert compare(spark, con, data, name).startswith("ROWS" if name in NO_TWIN else "OK")


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["garment_type", "total", "defects"]
    assert rows.count() > 0


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
