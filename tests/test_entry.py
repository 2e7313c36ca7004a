import pytest

import __spark_entry__ as contract
from checks.compare import compare
from checks.oracles import ORACLES
from checks.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) == {
        "normality",
        "profile_lineitem",
        "profile_wide",
        "fk_overlap_sampled",
    }


def test_flagship(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 11 and all(r["total_count"] > 0 for r in rows)


@pytest.mark.parametrize(
    "name", ["profile_metrics", "mega_profile", "skipped_operations", "fk_overlap", "kv_get"]
)
def test_queries_agree_with_their_sql(spark, name):
    assert compare(spark, SMALL, name) == ""
