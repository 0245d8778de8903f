"""The subpackage's queries agree with their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

from tilewright.llm import queries
from tilewright.plans.compare import value

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(value(tuple(r)) for r in df.select(*cols).collect())
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        res = con.execute(queries.SQL[name])
        head = [c[0] for c in res.description]
        order = sorted(range(len(head)), key=lambda i: head[i])
        assert sorted(head) == cols
        assert got == Counter(value(tuple(r[i] for i in order)) for r in res.fetchall())
