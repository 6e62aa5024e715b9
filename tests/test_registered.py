"""Every registered query against its SQL on the test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as spark_entry  # noqa: E402
from compare import connect, differences  # noqa: E402

SQL = {name: text for name, text in spark_entry.oracle_sql().items() if name not in spark_entry.CORPUS_SQL}
QUERIES = {name: query for name, query in spark_entry.queries().items() if name not in spark_entry.CORPUS_QUERIES}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["t", "pod", "request_memory", "request_cpu", "limit_memory", "limit_cpu"]
