"""Every registered query next to its SQL on the smallest data set."""

from pathlib import Path

import pytest

from verification.compare import database, differences
from verification.oracles import oracle_sql
from verification.queries import all_queries, model_queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def connection():
    made = database(FOLDER)
    yield made
    made.close()


def test_every_query_but_the_models_has_sql():
    assert set(oracle_sql()) == set(all_queries()) - set(model_queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, connection, name):
    assert differences(spark, connection, FOLDER, name) == []
