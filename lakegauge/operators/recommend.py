"""Recommendations: review list, lowest-dimension advice, themes and counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators.rankings import attention

TEXTS = ("run_id", "prioridade", "dataset_label", "recomendacao")


def review_recommendations(detail: DataFrame, run_id: str, n: int = 10) -> DataFrame:
    """One row per column to review (the n lowest), or one row saying there is none."""
    rows = attention(detail, n).select(
        F.lit(run_id).alias("run_id"), F.lit("Alta").alias("prioridade"), "dataset_label",
        F.format_string(C.REVIEW_TEXT, "column_name", "dataset_label").alias("recomendacao"))
    fallback = F.array(F.struct(F.lit(run_id).alias("run_id"), F.lit("Média").alias("prioridade"),
                                F.lit("").alias("dataset_label"), F.lit(C.REVIEW_EMPTY).alias("recomendacao")))
    # at most n rows, read once
    listed = rows.agg(F.collect_list(F.struct("run_id", "prioridade", "dataset_label", "recomendacao")).alias("r"))
    return listed.select(F.inline(F.when(F.size("r") > 0, F.col("r")).otherwise(fallback)))


def fill_defaults(recs: DataFrame) -> DataFrame:
    """Trimmed texts, absent columns as '', fixed texts for a blank priority or dataset."""
    blank = {"prioridade": C.PRIORITY_UNSET, "dataset_label": C.DATASET_UNSET}
    types = {f.name: f.dataType for f in recs.schema.fields}
    texts = {t: cells.safe_str(F.col(t), types[t]) if t in types else F.lit("") for t in TEXTS}
    return recs.withColumns({
        t: F.when(c == "", blank[t]).otherwise(c) if t in blank else c for t, c in texts.items()})


def with_theme(recs: DataFrame) -> DataFrame:
    return fill_defaults(recs).withColumn("tema", scoring.recommendation_theme(F.col("recomendacao")))


def rec_counts(recs: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Recommendations per value of `by`, fewest first; with n only the n largest."""
    counts = recs.groupBy(by).agg(F.count(F.lit(1)).alias("quantidade"))
    if n is not None:
        counts = counts.orderBy(F.col("quantidade").desc(), F.col(by).asc()).limit(n)
    return counts.orderBy(F.col("quantidade").asc(), F.col(by).desc())


def rec_totals(recs: DataFrame) -> DataFrame:
    priority = F.lower("prioridade")
    return recs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(priority == "alta").alias("alta"),
        F.count_if(priority.isin("média", "media")).alias("media"),
        F.count_distinct("dataset_label").alias("datasets"))


def lowest_dimension_advice(dims: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Lowest dimension of each row with its likely cause and the advice for it."""
    names = columns or {C.DIMENSION_LABELS[d]: d for d in C.DIMENSIONS}
    cause = {d: a[0] for d, a in C.DIMENSION_ADVICE.items()}
    advice = {d: a[1] for d, a in C.DIMENSION_ADVICE.items()}
    return dims.withColumn("lowest_dimension", scoring.lowest_dimension(names)).withColumns({
        "root_cause": scoring.lookup(F.col("lowest_dimension"), cause, C.ADVICE_DEFAULT[0]),
        "recommendation": scoring.lookup(F.col("lowest_dimension"), advice, C.ADVICE_DEFAULT[1]),
    })
