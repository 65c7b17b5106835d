"""Order-free comparison of query results."""

import math
import os

import duckdb
import pandas as pd


def plain(value):
    if isinstance(value, (list, dict)):
        return repr(value)
    if value is None or value is pd.NA or value is pd.NaT:
        return None
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "year"):
        return str(pd.Timestamp(value))
    if isinstance(value, str):
        return value
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    return int(value) if float(value) == int(value) else round(float(value), 9)


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con.execute(sql).df()
