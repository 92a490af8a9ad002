"""Rows of a query and of its SQL in DuckDB, in one order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def agree(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows(names, got.fetchall())
    assert sorted(names) == sorted(df.columns)
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    known, got_ = set(want), set(have)
    extra, missing = [x for x in have if x not in known][:3], [x for x in want if x not in got_][:3]
    assert len(have) == len(want) and have == want, f"{len(have)} rows, {len(want)} wanted; {extra} instead of {missing}"
