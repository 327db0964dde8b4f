"""Every registered query against its SQL, or that it runs with rows where SQL can't express it."""

import pytest

from tests_common import DATA, same
from loomgraph.plans import registry

#: Nothing of this kind in the smallest tables.
EMPTY = {"str_03_symbols"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLES:
        same(duck, df, registry.ORACLES[name])
    else:
        assert df.count() > 0 or name in EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
