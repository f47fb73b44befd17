import pathlib

import pytest

import __spark_entry__ as entry
from nearkin.plans.oracle import ORACLE
from nearkin.plans.queries import QUERIES
from scripts.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="needs the test tables")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score", "source", "lang"]


@pytest.mark.parametrize(
    "name", ["predict", "dot_dense", "cosine_nan", "clean_issue", "lemma", "standardize", "write_csv", "feedback_counts"]
)
def test_agrees_with_sql(spark, name):
    assert compare(spark, connect(SF), name, SF) == ""
