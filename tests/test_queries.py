"""Every query with an oracle against DuckDB; the others run and give rows of a fixed schema."""

import pytest

from loomstack.plans import registry
from tests.conftest import FIXTURES

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, agree, name):
    agree(registry.QUERIES[name](spark, FIXTURES), registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, FIXTURES)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
