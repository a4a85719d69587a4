"""Every registered graph query against its SQL; the driver's contract."""

import __spark_entry__ as entry
import pytest

from weftgraph.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, same_rows):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.SQL:
        same_rows(df, catalog.SQL[name], sf_dir)
    else:
        df.collect()


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "value"]


def test_every_graph_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
