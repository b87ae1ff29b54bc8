import sys
from pathlib import Path as _P

sys.path.insert(0, str(_P(__file__).resolve().parent))
from pathlib import Path

import pytest

from ledgerline import queries as core
from oracle import differences

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the generated tables are not here")


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    rows, apart = differences(spark, core.queries()[name], core.oracle_sql()[name], SF)
    assert not apart


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_returns_rows(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "block_features_daily" in e.queries()
    assert len(e.entry(spark).columns) == 92
