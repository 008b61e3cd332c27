"""Each query with a DuckDB text against that text, on the smallest tables."""

import duckdb
import pytest

from lorekiln.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    def one(x):
        if x is None or x != x:
            return "NULL"
        if isinstance(x, float):
            return str(round(x, 6) + 0.0)
        return str(x)[:19] if hasattr(x, "isoformat") else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    wanted = duck.sql(ORACLES[name])
    assert columns == sorted(wanted.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert normal(got.select(*columns).collect()) == normal(duck.sql(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall())
