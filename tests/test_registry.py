"""Every query of the engine proper against its SQL."""

import duckdb
import pytest

from ledgerlake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.queries())
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(registry.oracle_sql()[name])
    assert sorted(d[0] for d in told.description) == columns
    rows = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    shown = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted((shown(r) for r in df.select(*columns).collect()), key=repr) == sorted(map(shown, rows), key=repr)
