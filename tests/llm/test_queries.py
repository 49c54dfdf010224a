"""Every query of the package next to its reference SQL on the smallest data set."""

import check_oracle
import pytest
from runlens.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_oracle.connect(SMALL)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    outcome = check_oracle.compare(spark, con, SMALL, key)
    assert outcome.startswith("ok" if key in ORACLES else "rows only"), outcome


def test_all_operators_and_the_pipeline_are_registered():
    numbers = sorted(int(key[2:].split("_")[0]) for key in QUERIES)
    assert set(range(1, 11)) <= set(numbers) and len(set(numbers)) == len(numbers)
    assert "pipeline" in check_oracle.contract.queries()
