"""Run a query in Spark and its SQL in DuckDB and compare the rows."""
from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Spark type -> DuckDB types that hold the same values.
SAME = {
    "string": {"VARCHAR"}, "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _clean(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    return v


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    cols = sorted(spark_df.columns)
    types = dict(spark_df.dtypes)
    cur = con.execute(f"SELECT * FROM ({sql}) AS result_rows")
    theirs_names = [d[0] for d in cur.description]
    if sorted(theirs_names) != cols:
        return f"columns {cols} != {sorted(theirs_names)}"
    theirs = [tuple(_clean(r[theirs_names.index(c)]) for c in cols) for r in cur.fetchall()]
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE SELECT * FROM ({sql}) AS result_rows").fetchall()}
    for c in cols:
        if described[c] not in SAME[types[c]]:
            return f"type of {c}: {types[c]} != {described[c]}"
    ours = [tuple(_clean(r[c]) for c in cols) for r in spark_df.collect()]

    def key(row):
        return tuple((v is None, str(v) if v is not None else "") for v in row)

    ours.sort(key=key)
    theirs.sort(key=key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference: {dict(zip(cols, a))} != {dict(zip(cols, b))}"
    return None if ours else "no rows"
