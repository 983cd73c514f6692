import math
import time

import duckdb
import pytest

from opsloom.llm import oracle, queries

SF = "/root/testdata/sf0.01"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: round(x, 9) if isinstance(x, float) and not math.isnan(x) else x
    return sorted([tuple(show(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    began = time.time()
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = plain(want.fetchall(), names)
    print(name, "SQL", round(time.time() - began, 1), "s")
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == want and want
