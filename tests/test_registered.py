"""Registered queries against their SQL on the smallest tables; the slow ones run by tests/oracle.py."""

import os

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
SLOW = ("m1_", "m2_", "m3_", "m7_", "m9_", "m10_", "m11_", "p7_", "p14_", "o5_", "j11_", "x1_tree", "x4_", "s6_", "s8_", "t4_", "t7_", "t8_", "t10_")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
QUERIES, TEXTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in TEXTS if not n.startswith(SLOW)])
def test_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, TEXTS[name]) == []


def test_features_agree_with_sql(spark, con):
    assert differences(QUERIES["m1_features_split"](spark, SF_DIR), con, TEXTS["m1_features_split"]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def test_every_text_belongs_to_a_query():
    assert set(TEXTS) <= set(QUERIES)
