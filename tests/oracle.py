"""Compare a registered query with its SQL in DuckDB: names, row count and values."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def kinds(table) -> dict[str, str]:
    """Column types without the details that differ between the engines."""
    return {f.name: str(f.type).replace("large_", "").replace("[us, tz=UTC]", "[us]") for f in table.schema}


def rows(table) -> tuple[list[str], Counter]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, Counter(tuple(plain(v) for v in row) for row in zip(*columns))


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[list[str], int]:
    """Problems found, and the number of rows."""
    got = query(spark, sf_dir).toArrow()
    want = con.sql(sql).to_arrow_table()
    problems = []
    g_names, g_rows = rows(got)
    w_names, w_rows = rows(want)
    if g_names != w_names:
        return [f"columns {g_names} != {w_names}"], got.num_rows
    g_kinds, w_kinds = kinds(got), kinds(want)
    for name in g_names:
        if g_kinds[name] != w_kinds[name]:
            problems.append(f"type of {name}: {g_kinds[name]} != {w_kinds[name]}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} != {want.num_rows}")
    if g_rows != w_rows:
        only_g = list((g_rows - w_rows).elements())[:2]
        only_w = list((w_rows - g_rows).elements())[:2]
        problems.append(f"values differ, {sum((g_rows - w_rows).values())} rows; ours {only_g} theirs {only_w}"[:1500])
    return problems, got.num_rows
