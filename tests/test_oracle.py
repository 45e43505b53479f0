"""Every registered query of the library against its SQL, on the smallest supplied tables."""

import duckdb
import pytest

from ferrograph import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if value.__class__.__name__ == "Decimal":
        return round(float(value), 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    wanted = duck.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, df.collect()) == rows(wanted.columns, wanted.fetchall())
