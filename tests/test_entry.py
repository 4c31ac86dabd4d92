import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_core_query_has_sql():
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in registry.queries() if n != "stream_exact_replay"])
def test_against_sql(spark, name):
    found = registry.queries()[name](spark, SF).toPandas()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        expected = c.execute(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    rows = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert rows(found) == rows(expected)


def test_all_attributions_are_looked_up(spark, monkeypatch):
    from tidemark.plans import queries

    seen = {}
    monkeypatch.setattr(queries.tables, "conflicts", lambda new, stored, key, content: seen.update(new=new) or new)
    queries.output_conflicts(spark, SF)
    assert seen["new"].where("page_view_id % 3 <> 0").count() > 0
