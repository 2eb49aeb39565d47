"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import comparison
import pytest

import __spark_entry__ as entry
from lodemark import plans


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf_dir, name):
    got = plans.queries()[name](spark, sf_dir)
    if name in plans.oracle_sql():
        assert comparison.differences(got, plans.oracle_sql()[name], sf_dir) == ""
    else:
        assert got.count() > 0


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
