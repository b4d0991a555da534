"""Compares a query with its DuckDB counterpart: rows as multisets, columns by name, doubles to six decimals."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    return "[" + ",".join(map(_plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


def differences(spark, query, sql: str, sf_dir: str) -> list:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    return [(a, b) for a, b in zip(ours, theirs) if a != b] + [(len(ours), len(theirs))] * (len(ours) != len(theirs))
