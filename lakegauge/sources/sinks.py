"""Writing results: replace, append, and replacement of a single run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from lakegauge.schemas import align


def write_table(df: DataFrame, name: str, mode: str = "replace") -> None:
    """Catalog table, replaced or appended to (created when absent)."""
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode: {mode}")
    df.write.mode("overwrite" if mode == "replace" else "append").saveAsTable(name)


def write_run(df: DataFrame, path: str, keys: Sequence[str] = ("run_id",)) -> None:
    """Replaces the rows of the runs (or run and object) in `df`, and only those."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def append_run(df: DataFrame, path: str, keys: Sequence[str] = ("run_id",)) -> None:
    df.write.mode("append").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All runs under a path in the given layout; columns that older files lack are null.

    Tables of runs take run_id from their folders. A log holds all its columns, whatever folders its files lie in.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", "source_file" in schema.fieldNames())
    try:
        return align(reader.parquet(path), schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_step(df: DataFrame, path: str, step: int) -> DataFrame:
    """Writes the rows of a step of a growing state, replacing an earlier attempt, and returns them as stored."""
    where = f"{path.rstrip('/')}/step={step}"
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def read_steps(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all steps with their step; none where nothing has been written."""
    return read_runs(spark, path, T.StructType([*schema.fields, T.StructField("step", T.IntegerType())]))


def clear_step(spark: SparkSession, path: str, step: int) -> None:
    fs, where, java = _file_system(spark, path)
    fs.delete(java(where, f"step={step}"), True)


def _file_system(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = java(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where, java


def clear_run(spark: SparkSession, path: str, run_id: str) -> None:
    """Removes the rows of one run, so that a repeated run leaves nothing of its earlier attempt behind."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    fs, where, java = _file_system(spark, path)
    fs.delete(java(where, f"run_id={name}"), True)


def append_run_log(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Adds log rows in the log's layout, a folder per source; an older log keeps its rows, its absent columns read as null."""
    rows = align(df, schema)
    rows.withColumn("source_key", F.col("source_file")).write.mode("append").partitionBy("source_key").parquet(path)


def replace_in_log(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Adds log rows and removes all earlier rows of their sources.

    The new rows are written first and the files that held the earlier ones are deleted last, so at no moment is a source
    without a row: a run that ends in between leaves both, of which the later counts, and the next run removes them. An
    older log of files that several sources share is taken apart once.
    """
    spark = df.sparkSession
    name = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    fs, where, java = _file_system(spark, path)
    sources = [r["source_file"] for r in df.select("source_file").distinct().collect()]  # the files of one batch
    folders = [java(where, f"source_key={name(s)}") for s in sources]
    old = [f.getPath() for d in folders if fs.exists(d) for f in fs.listStatus(d)]
    shared = [f.getPath() for f in fs.listStatus(where) if f.isFile() and not f.getPath().getName().startswith("_")] if fs.exists(where) else []
    if shared:
        kept = align(spark.read.schema(schema).parquet(*[f.toString() for f in shared]), schema).join(df.select("source_file"), "source_file", "left_anti")
        append_run_log(kept, path, schema)
    append_run_log(df, path, schema)
    remove(fs, [*old, *shared])


def remove(fs, files) -> None:
    for f in files:
        fs.delete(f, False)
