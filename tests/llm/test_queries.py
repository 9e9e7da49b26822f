import glob
import os

import duckdb
import pytest

from marquee.llm import queries
from tests.test_oracle import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_a_query_for_each_operator():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
