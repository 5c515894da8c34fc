"""Queries of the corpus operators against their SQL in DuckDB."""

import os

import oracle
import pytest

from querent.llm.queries import ORACLES, QUERIES

FOLDER = os.path.join(os.environ.get("QUERENT_TESTDATA", "/root/testdata"), "sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert oracle.differences(spark, FOLDER, QUERIES[name], ORACLES[name]) == ""
