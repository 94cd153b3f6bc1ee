"""A dataset to be measured: a lazy DataFrame, its label and where it comes from."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells
from lakegauge.schemas import ENVELOPE_TEXTS
from lakegauge.session import work_path


@dataclass(frozen=True)
class Dataset:
    label: str
    df: DataFrame = field(compare=False)
    meta: Mapping[str, str] = field(default_factory=dict)


def file_meta(path: str) -> dict[str, str]:
    name = os.path.basename(path.rstrip("/"))
    return {"source_type": "file", "source": "file", "source_name": name, "file_name": name, "source_ref": path,
            "object_name": name, "dataset_name": name, "table_name": "", "sheet_name": ""}


def table_meta(source_type: str, source_name: str, source_ref: str, schema: str, table: str) -> dict[str, str]:
    label = f"{schema}.{table}" if schema else table
    return {"source_type": source_type, "source": source_type, "source_name": source_name, "file_name": "",
            "source_ref": source_ref, "object_name": label, "dataset_name": label, "table_name": table,
            "sheet_name": ""}


def capped(df: DataFrame, limit: int | None) -> DataFrame:
    """Some rows of a plan, for a copy that is written once; see `head` for rows that stay the same wherever they are used."""
    return df.limit(limit) if limit and limit > 0 else df


def head(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of a table of Parquet files, in order of file path and place in the file.

    Rows are counted file by file, in growing groups, until the cap is reached; then the cap is a filter on path and row
    number. So it costs no shuffle and no single task, files behind the cap are not opened, and every use of the result
    sees the same rows. Any other plan is capped into a copy.
    """
    if not limit or limit <= 0:
        return df
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        numbered = df.select(path.alias("path"), place.alias("place"))
    except AnalysisException:
        copy = work_path(df.sparkSession, "capped")
        capped(df, limit).write.parquet(copy)
        return df.sparkSession.read.schema(df.schema).parquet(copy)
    # the list of files spells an empty authority as ///, the rows spell it as /
    files, at, group, taken = sorted(re.sub("^([^/:]+):///", r"\1:/", f) for f in numbered.inputFiles()), 0, 1, 0
    while at < len(files):
        some = df.where(path.isin(files[at:at + group])).select(path.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        for last, n in sorted(tuple(r) for r in some.collect()):
            if taken + n >= limit:
                return df.where((path <= last) & ((path < last) | (place < limit - taken)))
            taken += n
        at, group = at + group, group * 2
    return df


def run_id_of(moment: datetime) -> str:
    return moment.strftime(C.RUN_ID_FORMAT)


def envelope(dataset: Dataset, run_id: str, scanned_at: datetime) -> dict[str, Column]:
    """Run and source as literal columns; blank names fall back to the label."""
    text = {k: (dataset.meta.get(k) or "").strip() for k in ENVELOPE_TEXTS}
    text["object_name"] = text["object_name"] or dataset.label
    text["dataset_name"] = text["dataset_name"] or dataset.label
    text["dataset"] = text["dataset_name"]
    return {"run_id": F.lit(run_id), "scanned_at": cells.moment(scanned_at),
            **{k: F.lit(v) for k, v in text.items()}}


def with_envelope(df: DataFrame, dataset: Dataset, run_id: str, scanned_at: datetime) -> DataFrame:
    """Stamps run and source on every row."""
    return df.select(*[v.alias(k) for k, v in envelope(dataset, run_id, scanned_at).items()], "*")


def scan_parquet(spark: SparkSession, path: str, limit: int | None = None) -> Dataset:
    meta = file_meta(path)
    return Dataset(meta["dataset_name"], head(spark.read.parquet(path), limit), meta)


def scan_table(spark: SparkSession, name: str, limit: int | None = None) -> Dataset:
    """A catalog table or view by its name."""
    schema, _, table = name.rpartition(".")
    meta = {**table_meta("catalog", "catalog", name, schema, table), "object_name": name, "dataset_name": name}
    return Dataset(name, head(spark.table(name), limit), meta)


def sample_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows in the order of a hash of their key: as good as random, yet repeatable."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (keys or df.columns)]
    return df.orderBy(F.md5(F.concat_ws("|", *texts)), *[F.col(k) for k in keys]).limit(n)
