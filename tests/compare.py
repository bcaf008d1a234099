"""Compare a query with its SQL on DuckDB: columns, types' families and rows in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(df: pd.DataFrame):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "~"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, float) or str(type(v)).find("float") >= 0:
            return repr(round(float(v), 9) + 0.0)
        if hasattr(v, "tolist"):
            v = v.tolist()
        return str(int(v)) if not isinstance(v, bool) and str(type(v)).find("int") >= 0 else str(v)

    ordered = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in ordered.itertuples(index=False))


#: Types that may stand for each other in a comparison of results.
SAME = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def type_differences(spark_df, sql, sf_dir):
    got = {r[0]: str(r[1]) for r in connection(sf_dir).execute(f"DESCRIBE {sql}").fetchall()}
    return [(n, t, got.get(n)) for n, t in spark_df.dtypes if SAME.get(t, t) != got.get(n)]


def differences(spark_df, sql, sf_dir):
    own = [tuple(r) for r in spark_df.select(sorted(spark_df.columns)).collect()]
    a = pd.DataFrame(own, columns=sorted(spark_df.columns), dtype=object)
    got = connection(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    b = pd.DataFrame(got.fetchall(), columns=names, dtype=object)
    if sorted(a.columns) != sorted(b.columns):
        return [f"columns {sorted(a.columns)} and {sorted(b.columns)}"]
    x, y = rows(a), rows(b)
    return [] if x == y else [f"{len(x)} and {len(y)} rows", *[str(p) for p in zip(x, y) if p[0] != p[1]][:3]]
