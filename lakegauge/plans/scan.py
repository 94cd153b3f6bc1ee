"""A full scan: profile, dimensions, scores, classes and rule results of many datasets."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from lakegauge import schemas
from lakegauge.operators import dimensions
from lakegauge.operators.profile import profiles, table_metrics
from lakegauge.operators.rules import aggregates, compiled, evaluate_rules, fixed_rows, no_test, results_of, rules_for
from lakegauge.session import work_path
from lakegauge.sources.datasets import Dataset, envelope, with_envelope
from lakegauge.sources.sinks import append_run, clear_run

_KEYS = [f.name for f in schemas.ENVELOPE.fields]
RESULT_TABLES = ("profile", "table_metrics", "column_metrics", "table_scores", "column_scores", "rule_results")


@dataclass(frozen=True)
class ScanResult:
    """Lazy result tables of one run, in their fixed layouts."""
    profile: DataFrame
    table_metrics: DataFrame
    column_metrics: DataFrame
    table_scores: DataFrame
    column_scores: DataFrame
    rule_results: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        out = {"table_metrics": self.table_metrics, "column_metrics": self.column_metrics,
               "table_scores": self.table_scores, "column_scores": self.column_scores}
        return out if self.rule_results is None else {**out, "rule_results": self.rule_results}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scan_profile(datasets: Iterable[Dataset], run_id: str, scanned_at: datetime, **options) -> DataFrame:
    """Profiles of all datasets under their envelopes; one lazy plan."""
    return profiles([(envelope(d, run_id, scanned_at), d.df) for d in datasets], **options)


def table_scores(p: DataFrame, *keys: str) -> DataFrame:
    return dimensions.scored(dimensions.dimension_scores(p, *keys)).withColumn("dimension_count", F.lit(6).cast("bigint"))


def column_scores(p: DataFrame) -> DataFrame:
    return dimensions.scored(dimensions.column_dimension_scores(p))


def results(p: DataFrame, rule_results: DataFrame | None = None) -> ScanResult:
    """Everything that follows from a profile; these tables have one row per dataset or column."""
    return ScanResult(
        p,
        schemas.align(table_metrics(p, *_KEYS), schemas.TABLE_METRICS),
        schemas.align(p, schemas.COLUMN_METRICS),
        schemas.align(table_scores(p, *_KEYS), schemas.TABLE_SCORES),
        schemas.align(column_scores(p), schemas.COLUMN_SCORES),
        rule_results,
    )


def rule_results(datasets: Iterable[Dataset], rules: Mapping[str, Any], run_id: str, scanned_at: datetime
                 ) -> DataFrame | None:
    parts = []
    for d in datasets:
        wanted = rules_for(rules, d.meta.get("dataset_name") or d.label)
        if wanted:
            rows = evaluate_rules(d.df, wanted).withColumn("rule_score", F.col("score"))
            parts.append(schemas.align(with_envelope(rows, d, run_id, scanned_at), schemas.RULE_RESULTS))
    return _union(parts) if parts else None


def measured(datasets: list[Dataset], rules: Mapping[str, Any], run_id: str, scanned_at: datetime, **options
             ) -> tuple[DataFrame, DataFrame | None]:
    """Profile and rule results of some datasets.

    With exact distincts both come from one reading of every column and one pass over distinct values, whose outcome is
    stored before it is taken apart; else rules are counted on their own.
    """
    wanted = [rules_for(rules, d.meta.get("dataset_name") or d.label) for d in datasets]
    if not any(wanted) or options.get("distinct", "exact") != "exact":
        return scan_profile(datasets, run_id, scanned_at, **options), rule_results(datasets, rules, run_id, scanned_at)
    spark = datasets[0].df.sparkSession
    made = [compiled(d.df, own) for d, own in zip(datasets, wanted)]
    both = profiles([(envelope(d, run_id, scanned_at), d.df) for d in datasets], extras=[aggregates(tests) for _, tests in made],
                    none=no_test(), **options)
    path = work_path(spark, "measured")
    both.write.parquet(path)
    both = spark.read.schema(both.schema).parquet(path)
    parts = [results_of(both, *_KEYS)] + [with_envelope(fixed_rows(spark, fixed), d, run_id, scanned_at)
                                          for d, (fixed, _) in zip(datasets, made) if fixed]
    tested = _union([schemas.align(p.withColumn("rule_score", F.col("score")), schemas.RULE_RESULTS) for p in parts])
    return both.drop("extra"), tested


def run_scan(datasets: list[Dataset], rules: Mapping[str, Any], run_id: str, scanned_at: datetime, out: str,
             batch: int = 16, **options) -> dict[str, str]:
    """Measures the datasets and writes every result table under `out`, replacing this run.

    The data are read for the profile and the rules only, for both together: profiles and rule results are written
    first, `batch` datasets per job, and all other tables are computed from what was written.
    """
    if not datasets:
        return {}
    spark = datasets[0].df.sparkSession
    paths = {n: os.path.join(out, n) for n in RESULT_TABLES}
    for path in paths.values():
        clear_run(spark, path, run_id)
    layout = None
    for at in range(0, len(datasets), batch):
        part, tested = measured(datasets[at:at + batch], rules, run_id, scanned_at, **options)
        layout = part.schema
        append_run(part, paths["profile"])
        if tested is not None:
            append_run(tested, paths["rule_results"])
    # with its layout, as a run id would else be read as the number or date it may look like
    p = spark.read.schema(layout).parquet(paths["profile"]).where(F.col("run_id") == run_id)
    for name, table in results(p).tables().items():
        append_run(table, paths[name])
    if not any(rules_for(rules, d.meta.get("dataset_name") or d.label) for d in datasets):
        del paths["rule_results"]
    return paths
