"""Every registered query of the engine against its oracle in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tesselon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    value = lambda x: None if x is None else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracles().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
