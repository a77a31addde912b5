"""Spark rows against DuckDB rows, in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.sql(sql)
    return list(r.columns), r.fetchall()


def agree(frame, sf_dir, sql):
    columns, data = duck(sf_dir, sql)
    assert sorted(frame.columns) == sorted(columns)
    return rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(columns, data)
