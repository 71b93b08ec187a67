import os

import duckdb
import pytest

from strandmill.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
        result = con.execute(ORACLE[name])
        names = [c[0] for c in result.description]
        want = [tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()]
        assert sorted(names) == sorted(df.columns) and sorted(rows, key=repr) == sorted(want, key=repr)
    else:
        assert rows
