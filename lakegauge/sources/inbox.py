"""An inbox folder: which files are there, which changed, and reading each as a dataset."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegauge.sources.csv import scan_csv, scan_csv_files
from lakegauge.sources.datasets import Dataset, scan_parquet
from lakegauge.sources.digest import file_digests

READABLE = ("csv", "parquet")


def normalized_extensions(patterns: Iterable[str] | None) -> set[str]:
    """'*.CSV', '.csv' and 'csv' all mean csv."""
    kept = (str(p or "").strip().lower().replace("*", "").removeprefix(".") for p in patterns or ())
    return {p for p in kept if p}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Direct children of the folder: path, source_file, ext, size_bytes (contents are not read)."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size_bytes"))
    return _named(files)


def _named(files: DataFrame) -> DataFrame:
    """Adds the file name and its lower-case extension to rows with a path."""
    return files.withColumn("source_file", F.element_at(F.split("path", "/"), -1)).withColumn(
        "ext", F.lower(F.regexp_extract("source_file", r"\.([^.]+)$", 1)))


def read_file(spark: SparkSession, path: str, ext: str, limit: int | None = None, csv_sep: str = ",",
              csv_encoding: str = "utf-8") -> Dataset:
    if ext == "csv":
        return scan_csv(spark, path, csv_sep, csv_encoding, limit)
    if ext == "parquet":
        return scan_parquet(spark, path, limit)
    raise ValueError(f"unsupported extension: {ext}")


def scan_inbox(spark: SparkSession, folder: str, include_ext: Iterable[str] | None = None, limit: int | None = None,
               csv_sep: str = ",", csv_encoding: str = "utf-8") -> tuple[list[Dataset], list[tuple[str, str]]]:
    """Datasets of the wanted files in name order, and (file, reason) for those left out.

    The list of files comes to the driver, their contents do not. CSV files without a cap are read together.
    """
    wanted = normalized_extensions(include_ext)
    datasets, errors = [], []
    files = [f for f in list_files(spark, folder).orderBy("source_file").collect() if not wanted or f.ext in wanted]
    texts = {f.source_file: f.path for f in files if f.ext == "csv"}
    together = scan_csv_files(spark, texts, csv_sep, csv_encoding) if texts and not limit else {}
    for f in files:
        found = together.get(f.source_file)
        try:
            found = read_file(spark, f.path, f.ext, limit, csv_sep, csv_encoding) if found is None else found
        except Exception as error:  # one bad file must not stop the others
            found = str(error).splitlines()[0]
        if isinstance(found, Dataset):
            datasets.append(found)
        else:
            errors.append((f.source_file, found))
    return datasets, errors


def scan_sources(spark: SparkSession, config: Mapping[str, Any], limit: int | None = None
                 ) -> tuple[list[Dataset], list[tuple[str, str]]]:
    """All datasets of a sources mapping: {'files': {inbox, include_ext, ...}, 'databases': [...]}"""
    from lakegauge.sources.jdbc import JdbcSource, scan_database

    datasets, errors = [], []
    files = config.get("files") or {}
    if files:
        found, bad = scan_inbox(spark, files["inbox"], files.get("include_ext"), limit,
                                files.get("csv_sep") or ",", files.get("csv_encoding") or "utf-8")
        datasets, errors = datasets + found, errors + bad
    for cfg in config.get("databases") or []:
        try:
            found, bad = scan_database(spark, JdbcSource.from_config(cfg))
        except Exception as error:
            found, bad = [], [(str(cfg.get("name") or cfg.get("type")), str(error).splitlines()[0])]
        datasets, errors = datasets + found, errors + bad
    return datasets, errors


# --- change detection ------------------------------------------------------------

def file_hashes(spark: SparkSession, folder: str, include_ext: Iterable[str] | None = None) -> DataFrame:
    """path, source_file, ext, file_hash for the wanted files of the folder, whatever their size and kind.

    A file is read as bytes between line feeds, in parallel over its splits; the hash covers its length, the pieces and
    their order (see `digest`), and does not depend on how the file is split. Files of other extensions are not opened.
    """
    wanted = normalized_extensions(include_ext)
    names = list_files(spark, folder)
    if wanted:
        names = names.where(F.col("ext").isin(sorted(wanted)))
    reader = spark.read.option("lineSep", "\n")
    if wanted:
        letters = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(letters(e) for e in sorted(wanted)) + "}")
    pieces = reader.text(folder).select(
        F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("name"),
        F.col("_metadata.file_block_start").alias("start"), "value")
    said = file_digests(pieces, "name", "start", "value")
    out = names.join(said, names.source_file == said.name, "left")
    return out.select("path", "source_file", "ext", F.sha2(
        F.concat_ws(":", F.col("size_bytes").cast("string"), F.coalesce("digest", F.lit("0"))), 256).alias("file_hash"))


def changed_files(hashes: DataFrame, log: DataFrame, mode: str = "skip") -> DataFrame:
    """Files to process: with 'skip' those whose (name, hash) the log lacks, else all."""
    if mode not in ("skip", "append", "replace"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "skip":
        return hashes
    return hashes.join(log.select("source_file", "file_hash"), ["source_file", "file_hash"], "left_anti")


def kept_log(log: DataFrame, processed: DataFrame, mode: str = "skip") -> DataFrame:
    """Log rows that stay: 'replace' drops the earlier rows of the files being processed."""
    return log.join(processed.select("source_file"), "source_file", "left_anti") if mode == "replace" else log
