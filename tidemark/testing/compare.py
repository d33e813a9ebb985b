"""Order-insensitive comparison of a Spark result with a DuckDB query.

Mirrors the driver's check: same row count, same column names, and the same
multiset of rows once columns are sorted by name and values normalised.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math

import duckdb

from tidemark.sources.testdata import TABLE_NAMES


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLE_NAMES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.10g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.12g}")
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [names[i] for i in order], out


def compare(spark_df, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck_connection(sf_dir)
    rel = con.sql(sql)
    d_names, d_rows = _rows(list(rel.columns), rel.fetchall())
    s_names, s_rows = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "columns_match": s_names == d_names,
        "values_match": s_rows == d_rows,
    }
    if not result["columns_match"]:
        result["spark_columns"] = s_names
        result["oracle_columns"] = d_names
    if not result["values_match"] and result["columns_match"]:
        ss, ds = set(s_rows), set(d_rows)
        result["only_spark"] = [r for r in s_rows if r not in ds][:3]
        result["only_oracle"] = [r for r in d_rows if r not in ss][:3]
    return result
