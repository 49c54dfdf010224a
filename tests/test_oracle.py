"""Every query next to its reference SQL on the smallest data set."""

import check_oracle
import pytest
from runlens.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SMALL)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    outcome = check_oracle.compare(spark, con, SMALL, key)
    assert outcome.startswith(("ok", "rows only")), outcome


def test_contract(spark):
    queries, oracles = check_oracle.contract.queries(), check_oracle.contract.oracle_sql()
    assert set(oracles) <= set(queries)
    # This one is compared with a plain parse in test_free_text.py.
    assert set(QUERIES) - set(ORACLES) == {"syntax_free_text_verdicts"}
    assert set(QUERIES) <= set(queries)
    assert check_oracle.contract.entry(spark).count() > 0
