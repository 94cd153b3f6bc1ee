"""Choosing and loading runs, labels and score columns, filters, run comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators.profile import quoted


def latest_run(df: DataFrame, by: str = "scanned_at") -> DataFrame:
    """One row (run_id): the run with the greatest `by`; ties go to the greater run_id."""
    if by == "run_id":
        return df.agg(F.max("run_id").alias("run_id"))
    return df.where(F.col("run_id").isNotNull()).agg(F.max_by("run_id", F.struct(by, "run_id")).alias("run_id"))


def first_latest_run(candidates: Sequence[DataFrame]) -> DataFrame:
    """Greatest run_id of the first table that has any."""
    found = None
    for rank, df in enumerate(candidates):
        part = latest_run(df, "run_id").withColumn("rank", F.lit(rank))
        found = part if found is None else found.unionAll(part)
    return found.where(F.col("run_id").isNotNull()).agg(F.min_by("run_id", "rank").alias("run_id"))


def latest_per_source(log: DataFrame, source: str = "source_file", when: str = "run_ts") -> DataFrame:
    """Log rows of the latest run of every source, ties kept.

    The newest moment is aggregated first; the join then runs on source and
    moment, so a source that owns much of the log is spread by its moments.
    """
    newest = log.groupBy(source).agg(F.max(when).alias(when))
    return log.join(newest, [source, when], "left_semi")


def best_label(df: DataFrame) -> Column:
    """First filled name column of the row, else a fixed text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [cells.filled(quoted(n), types[n]) for n in C.LABEL_COLUMNS if n in types]
    return F.coalesce(*names, F.lit(C.LABEL_DEFAULT))


def score_column(df: DataFrame) -> str | None:
    return next((c for c in C.SCORE_COLUMNS if c in df.columns), None)


def score_value(df: DataFrame) -> Column:
    """The score as a number; absent or unreadable counts as 0."""
    name = score_column(df)
    if name is None:
        return F.lit(0.0)
    return F.coalesce(cells.to_number(quoted(name), df.schema[name].dataType), F.lit(0.0))


def class_value(df: DataFrame) -> Column:
    name = next((c for c in C.CLASS_COLUMNS if c in df.columns), None)
    return quoted(name) if name else scoring.classify(score_value(df), "report")


def labelled(df: DataFrame) -> DataFrame:
    """Adds dataset_label and classification where absent, and makes the score numeric."""
    name = score_column(df)
    added = {}
    if "dataset_label" not in df.columns:
        added["dataset_label"] = best_label(df)
    if name:
        added[name] = score_value(df)
        if not any(c in df.columns for c in C.CLASS_COLUMNS):
            added["classification"] = class_value(df)
    return df.withColumns(added)


def load_run(candidates: Sequence[DataFrame], run_id: str, detail: DataFrame | None = None) -> DataFrame:
    """Summary rows of a run from the first table that has some, else derived from the column rows.

    One lazy plan: the tables are stacked with their rank, and a semi-join on the lowest rank that has rows keeps one of
    them. The result has the columns of all tables, null where the chosen one lacks them; a column whose type differs
    between tables is text.
    """
    found = [df.where(F.col("run_id") == run_id) for df in candidates]
    parts = [labelled(df) for df in found]
    if detail is not None:
        found.append(detail.where(F.col("run_id") == run_id))
        parts.append(summary_from_columns(labelled(found[-1])))
    kinds: dict[str, set] = {}
    for part in parts:
        for f in part.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType)
    mixed = {n for n, types in kinds.items() if len(types) > 1}
    stacked = [p.withColumns({n: quoted(n).cast("string") for n in mixed & set(p.columns)}).withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), stacked)
    first = reduce(DataFrame.unionAll, [df.select(F.lit(i).alias("_rank")) for i, df in enumerate(found)]).agg(F.min("_rank").alias("_rank"))
    return rows.join(F.broadcast(first), "_rank", "left_semi").drop("_rank")  # one row


def summary_from_columns(detail: DataFrame) -> DataFrame:
    """Mean column score and class per run and dataset."""
    means = detail.groupBy("run_id", "dataset_label").agg(F.avg(score_value(detail)).alias("score"))
    return means.withColumn("classification", scoring.classify(F.col("score"), "report"))


def dimension_table(summary: DataFrame) -> DataFrame:
    """Dimension columns of the summary under their report names, absent ones 0."""
    names = {"completude": "dim_completude", "unicidade": "dim_unicidade", "consistencia": "dim_consistencia",
             "validade": "dim_validade", "integridade": "dim_integridade_ref", "freshness": "dim_freshness"}
    types = {f.name: f.dataType for f in summary.schema.fields}

    def number(name: str) -> Column:
        if name not in types:
            return F.lit(0.0)
        return F.coalesce(cells.to_number(quoted(name), types[name]), F.lit(0.0))

    return summary.select("run_id", "dataset_label", *[number(s).alias(d) for s, d in names.items()],
                          score_value(summary).alias("score_final"))


def filter_run(df: DataFrame, run_id: str | None = None, source_type: str | None = None,
               dataset: str | None = None, datasets: DataFrame | None = None,
               name: str = "dataset_name") -> DataFrame:
    """Rows of a run, source type and dataset; `datasets` keeps only names that survive there."""
    for column, wanted in (("run_id", run_id), ("source_type", source_type), (name, dataset)):
        if wanted is not None and column in df.columns:
            df = df.where(F.col(column) == wanted)
    if datasets is not None:
        keys = [c for c in ("run_id", name) if c in datasets.columns and c in df.columns]
        df = df.join(datasets.select(*keys).distinct(), keys, "left_semi")
    return df


def compare_runs(long: DataFrame, run_id: str, previous: str, *keys: str) -> DataFrame:
    """Score of a run beside that of an earlier one, per dimension; one grouping, no join."""
    at = lambda run: F.max(F.when(F.col("run_id") == run, F.col("score")))
    return (long.where(F.col("run_id").isin(run_id, previous)).groupBy(*keys, "dimension")
            .agg(at(run_id).alias("atual"), at(previous).alias("anterior"))
            .where(F.col("atual").isNotNull())
            .withColumn("delta", F.col("atual") - F.col("anterior")))
