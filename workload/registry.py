"""Registry of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakegauge.functions import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = exact_rounding(sql)
        return fn
    return add


def exact_rounding(sql: str) -> str:
    """round(x, n) spelled as printf, which rounds the binary value itself (ties to even).

    DuckDB's own round multiplies first, which moves values next to a tie.
    """
    at = sql.rfind(" round(")
    while at >= 0:
        depth, comma, i = 1, -1, at + len(" round(")
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            comma = i if ch == "," and depth == 1 else comma
            i += 1
        value, digits = sql[at + len(" round("):comma], sql[comma + 1:i - 1].strip()
        sql = f"{sql[:at]} printf('%.{digits}f', ({value})::DOUBLE)::DOUBLE{sql[i:]}"
        at = sql.rfind(" round(", 0, at)
    return sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, as the order of additions differs between engines."""
    return df.select(*[
        scoring.exact_round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])
