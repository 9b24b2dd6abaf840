"""Compare queries with their SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sessions command_events commands new_commands vector_meta doc_labels eval_items".split()


def connect(folder):
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = connect(folder).sql(sql)
    names = list(result.columns)
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert mine == theirs
