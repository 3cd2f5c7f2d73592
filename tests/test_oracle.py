"""Every registered query against its SQL twin, with chunks small enough to cross borders."""

import __spark_entry__ as entry
import check
import pytest
from conftest import SF


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name, small_chunks):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        status = check.compare(df, con, sql)
        assert status.startswith("ok"), status


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["run_id", "n_real", "n_generated", "wasserstein", "l1_by_group"]
