import os

import duckdb
import pytest

import __spark_entry__ as entry
from heliograph.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert norm(tuple(r[c] for c in want.columns) for r in rows) == norm(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partition_queries_keep_crowded_pixels(spark, tmp_path):
    """One pixel of the deepest order with more rows than any threshold."""
    spark.createDataFrame([(5,)] * 1000 + [(k,) for k in range(100, 400)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    parts = run("partition_map")
    assert sum(r.n for r in parts) == 1300 and max(r.n for r in parts) >= 1000
    assert run("partition_total")[0].n_sources == 1300
    assert len(run("partition_assign")) == 1300
    assert len(run("spatial_sort_key")) == len(parts)
    assert {(r.o1, r.p1) for r in run("partition_pairs")} == {(r.Norder, r.Npix) for r in parts}
    assert len({r.pix for r in run("partition_cover")}) == sum(4 ** (7 - r.Norder) for r in parts)
