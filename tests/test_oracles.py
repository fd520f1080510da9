"""Every query that SQL can express, beside an independent SQL engine."""

import pytest

from __spark_entry__ import oracle_sql, queries
from check_oracles import check, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# full-size fits; leave them out with -m "not slow"
SLOW = {n for n in oracle_sql() if n.startswith(("model_rf", "model_gbt", "model_svc", "model_kernel", "shap_tree"))}
NAMES = [pytest.param(n, marks=pytest.mark.slow) if n in SLOW else n for n in sorted(oracle_sql())]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    verdict, _, _ = check(spark, duck, FOLDER, name)
    assert verdict == "ok"


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
