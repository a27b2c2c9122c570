"""Every query of the library against its SQL."""

import pytest
from conftest import SF, same_rows

from weftline.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        same_rows(df, duck.sql(ORACLES[name]))
    else:
        assert df.columns and df.count() > 0
