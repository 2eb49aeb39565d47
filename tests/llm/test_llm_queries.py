"""The registered queries against their SQL, at the smallest scale."""

import comparison
import pytest

from lodemark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    assert comparison.differences(Q.queries()[name](spark, sf_dir), Q.oracle_sql()[name], sf_dir) == ""


def test_one_query_for_each_operator():
    found = [n.split("_")[0] for n in Q.queries() if n.startswith("op")]
    assert sorted(found) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in Q.queries()
