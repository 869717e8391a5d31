"""Every core query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from finpanel.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(cell(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "year"):
            return str(v)[:19].removesuffix(" 00:00:00")
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    return sorted((tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(canonical(got), canonical(want), strict=True) if a != b]
    assert not bad, bad[:3]


def test_queries_without_sql_are_few():
    assert set(QUERIES) - set(ORACLES) == {"p15_walk_forward"}
