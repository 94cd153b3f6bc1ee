"""Database sources: connection settings per product, table discovery, bounded table reads."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakegauge.sources.datasets import Dataset, table_meta

# --- fixed values: product -> URL, driver, default port, catalog query, row cap ----
_INFORMATION_SCHEMA = ("SELECT table_name AS table_name FROM information_schema.tables "
                       "WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE'")
_LIMIT = "SELECT * FROM {table} LIMIT {n}"
KINDS: dict[str, dict[str, Any]] = {
    "postgres": {"url": "jdbc:postgresql://{host}:{port}/{db}", "driver": "org.postgresql.Driver", "port": 5432,
                 "catalog": _INFORMATION_SCHEMA, "cap": _LIMIT, "quote": '""', "schema": "public"},
    "mysql": {"url": "jdbc:mysql://{host}:{port}/{db}", "driver": "com.mysql.cj.jdbc.Driver", "port": 3306,
              "catalog": _INFORMATION_SCHEMA, "cap": _LIMIT, "quote": "``", "schema": "{db}"},
    "mariadb": {"url": "jdbc:mariadb://{host}:{port}/{db}", "driver": "org.mariadb.jdbc.Driver", "port": 3306,
                "catalog": _INFORMATION_SCHEMA, "cap": _LIMIT, "quote": "``", "schema": "{db}"},
    "sqlserver": {"url": "jdbc:sqlserver://{host}:{port};databaseName={db}",
                  "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "port": 1433,
                  "catalog": _INFORMATION_SCHEMA, "cap": "SELECT TOP {n} * FROM {table}", "quote": "[]",
                  "schema": "dbo"},
    "oracle": {"url": "jdbc:oracle:thin:@//{host}:{port}/{db}", "driver": "oracle.jdbc.OracleDriver", "port": 1521,
               "catalog": "SELECT table_name AS \"table_name\" FROM all_tables WHERE owner = '{schema}'",
               "cap": "SELECT * FROM {table} FETCH FIRST {n} ROWS ONLY", "quote": '""', "schema": "{user}"},
    "sqlite": {"url": "jdbc:sqlite:{dbfile}", "driver": "org.sqlite.JDBC", "port": None,
               "catalog": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'",
               "cap": _LIMIT, "quote": '""', "schema": ""},
    "duckdb": {"url": "jdbc:duckdb:{dbfile}", "driver": "org.duckdb.DuckDBDriver", "port": None,
               "catalog": _INFORMATION_SCHEMA, "cap": _LIMIT, "quote": '""', "schema": "main"},
}
_NETWORK_FIELDS = ("host", "port", "db", "user", "password")


@dataclass(frozen=True)
class JdbcSource:
    kind: str
    name: str = ""
    host: str = ""
    port: int | None = None
    db: str = ""
    user: str = ""
    password: str = ""
    dbfile: str = ""
    include_schemas: Sequence[str] = ()
    include_tables: Sequence[str] = ()
    only: str | None = None
    limit: int | None = None
    fetch_size: int = 10_000

    @staticmethod
    def from_config(cfg: Mapping[str, Any]) -> "JdbcSource":
        """From a source entry of a configuration mapping (type, db or database, schema or include_schemas)."""
        kind = str(cfg.get("type") or "").strip().lower().removesuffix("_source")
        schemas = cfg.get("include_schemas") or ([cfg["schema"]] if cfg.get("schema") else [])
        return JdbcSource(
            kind=kind, name=str(cfg.get("name") or ""), host=str(cfg.get("host") or ""),
            port=int(cfg["port"]) if cfg.get("port") else None, db=str(cfg.get("db") or cfg.get("database") or ""),
            user=str(cfg.get("user") or ""), password=str(cfg.get("password") or ""),
            dbfile=str(cfg.get("dbfile") or ""), include_schemas=tuple(schemas),
            include_tables=tuple(cfg.get("include_tables") or ()), only=cfg.get("only") or None,
            limit=int(cfg["limit"]) if cfg.get("limit") else None)

    @property
    def dialect(self) -> dict[str, Any]:
        if self.kind not in KINDS:
            raise ValueError(f"unknown database kind: {self.kind!r}")
        return KINDS[self.kind]

    def missing_fields(self) -> list[str]:
        """Required settings that are blank."""
        if self.dialect["port"] is None:
            return [] if self.dbfile else ["dbfile"]
        given = {"port": self.port or self.dialect["port"]}
        return [f for f in _NETWORK_FIELDS if not given.get(f, getattr(self, f))]

    @property
    def schemas(self) -> list[str]:
        default = self.dialect["schema"].format(db=self.db, user=self.user.upper())
        return list(self.include_schemas) or [default]

    @property
    def reference(self) -> str:
        if self.dbfile:
            return self.dbfile
        return f"{self.host}:{self.port or self.dialect['port']}/{self.db}"

    def options(self) -> dict[str, str]:
        url = self.dialect["url"].format(host=self.host, port=self.port or self.dialect["port"], db=self.db,
                                         dbfile=self.dbfile)
        out = {"url": url, "driver": self.dialect["driver"], "fetchsize": str(self.fetch_size)}
        if self.user:
            out |= {"user": self.user, "password": self.password}
        return out

    def quoted(self, *names: str) -> str:
        opening, closing = self.dialect["quote"]
        return ".".join(opening + n.replace(closing, closing * 2) + closing for n in names if n)

    def catalog_query(self, schema: str) -> str:
        return self.dialect["catalog"].format(schema=schema.replace("'", "''"))

    def table_query(self, schema: str, table: str) -> str | None:
        """The capped read as the database's own SQL, so that the cap is applied there."""
        if not self.limit:
            return None
        return self.dialect["cap"].format(table=self.quoted(schema, table), n=self.limit)

    def wants(self, schema: str, table: str) -> bool:
        """include_tables holds bare or qualified names; `only` is searched in the bare name."""
        named = not self.include_tables or bool({table, f"{schema}.{table}"} & set(self.include_tables))
        return named and (self.only is None or re.search(self.only, table) is not None)


def list_tables(spark: SparkSession, source: JdbcSource) -> list[tuple[str, str]]:
    """(schema, table) of the wanted base tables, sorted; names only, so a list is fine."""
    found = []
    for schema in source.schemas:
        names = spark.read.format("jdbc").options(**source.options()).option(
            "query", source.catalog_query(schema)).load().toDF("table_name")
        found += [(schema, r.table_name) for r in names.collect() if source.wants(schema, r.table_name)]
    return sorted(found)


def scan_table(spark: SparkSession, source: JdbcSource, schema: str, table: str,
               partition_column: str | None = None, partitions: int = 64) -> Dataset:
    """One table, read in parallel ranges of a column; a capped read is one small query.

    Without a named column the first integer, date or timestamp column is taken.
    Only a table that has none of these is read through a single connection.
    """
    query = source.table_query(schema, table)
    if query is not None:
        df = _reader(spark, source).option("query", query).load()
    else:
        df = _ranged(spark, source, schema, table, partition_column, partitions)
    meta = table_meta(source.kind, source.name or f"{source.kind}_{source.db}_{schema}",
                      f"{source.reference}/{schema}" if schema else source.reference, schema, table)
    return Dataset(meta["dataset_name"], df, meta)


def _reader(spark: SparkSession, source: JdbcSource):
    return spark.read.format("jdbc").options(**source.options())


def range_column(df_schema: T.StructType) -> str | None:
    """First column whose values can be cut into ranges."""
    usable = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return next((f.name for f in df_schema.fields if isinstance(f.dataType, usable)), None)


def _ranged(spark: SparkSession, source: JdbcSource, schema: str, table: str, column: str | None,
            partitions: int) -> DataFrame:
    rel = source.quoted(schema, table)
    whole = _reader(spark, source).option("dbtable", rel).load()
    column = column or range_column(whole.schema)
    if column is None:
        return whole
    name = source.quoted(column)
    ends = _reader(spark, source).option("query", f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {rel}") \
        .load().toDF("lo", "hi").select(F.col("lo").cast("string"), F.col("hi").cast("string")).first()
    if ends is None or ends.lo is None:
        return whole
    return _reader(spark, source).option("dbtable", rel).options(
        partitionColumn=column, lowerBound=ends.lo, upperBound=ends.hi, numPartitions=str(partitions)).load()


def scan_database(spark: SparkSession, source: JdbcSource) -> tuple[list[Dataset], list[tuple[str, str]]]:
    """Every wanted table, and (label, reason) of those that cannot be opened."""
    datasets, errors = [], []
    missing = source.missing_fields()
    if missing:
        return [], [(source.name or source.kind, "missing settings: " + ", ".join(missing))]
    for schema, table in list_tables(spark, source):
        try:
            datasets.append(scan_table(spark, source, schema, table))
        except Exception as error:  # one bad table must not stop the others
            errors.append((f"{schema}.{table}", str(error).splitlines()[0]))
    return datasets, errors
