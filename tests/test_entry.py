"""Every query runs on the smallest tables and agrees with its SQL."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tilewright.plans.compare import value

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["kind", "id_a", "id_b"]
    for n in (2, 4, 5, 6, 7):
        assert f"p{n}_found" in entry.queries()


@pytest.mark.parametrize("name", [n for m in entry.MODULES if ".llm" not in m for n in __import__(m, fromlist=["QUERIES"]).QUERIES])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(value(tuple(r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        res = duck.execute(sql)
        head = [c[0] for c in res.description]
        order = sorted(range(len(head)), key=lambda i: head[i])
        assert sorted(head) == cols
        assert got == Counter(value(tuple(r[i] for i in order)) for r in res.fetchall())
