import os

import duckdb


def oracle(sql, sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def same_rows(df, sql, sf):
    names, want = oracle(sql, sf)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return len(got)
