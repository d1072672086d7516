"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import differences, duck

SF = "/root/testdata/sf0.001"
# these ask for more negatives than the smallest tables hold, which is an error by design
LARGER = "/root/testdata/sf0.01"
NEED_MORE = {"auroc_top_n", "top_abs_with_negatives"}


@pytest.fixture(scope="module")
def con():
    return {sf: duck(sf) for sf in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal(spark, con, name):
    sf = LARGER if name in NEED_MORE else SF
    assert differences(entry.queries()[name](spark, sf), con[sf], entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "median_log2FC" in out.columns
