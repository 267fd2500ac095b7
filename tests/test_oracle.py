"""Every query with SQL returns the rows that DuckDB returns for it, on the smallest driver tables."""

import os

import duckdb
import numpy as np
import pytest

from tilewright.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_match(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_the_rest_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pixels_that_round_up_to_a_whole_number(spark, tmp_path):
    """Floats whose thousandfold is whole only as a float."""
    con, near = duckdb.connect(), [x for x in np.arange(1, 500, dtype=np.float32) / np.float32(1000) if float(x) * 1000 < float(np.floor(x * np.float32(1000)))]
    assert len(near) > 9
    con.execute("create table embeddings (vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [(i, [float(near[(i * 64 + k) % len(near)]) for k in range(64)]) for i in range(8)])
    con.execute(f"copy embeddings to '{tmp_path}/embeddings.parquet' (format parquet)")
    df, want = QUERIES["training_arrays"](spark, str(tmp_path)), con.sql(ORACLES["training_arrays"])
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())


def test_entry_stands_without_the_optional_part():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
