"""Rows of the four history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lakegauge import constants as C
from lakegauge.functions import scoring
from lakegauge.operators.dimensions import to_long
from lakegauge.operators.recommend import lowest_dimension_advice
from lakegauge.operators.runs import class_value, score_value
from lakegauge.schemas import DATASET_HISTORY, DIMENSION_HISTORY, RECOMMENDATIONS, RUN_HISTORY, align


def run_history(scores: DataFrame, columns_scanned: str = "column_count") -> DataFrame:
    """Counts, mean score and its class, per run; report paths stay null."""
    return align(
        scores.groupBy("run_id").agg(
            F.max("scanned_at").alias("run_timestamp"), F.count(F.lit(1)).alias("datasets_count"),
            F.sum(columns_scanned).alias("columns_scanned"),
            scoring.exact_round(F.avg(score_value(scores)), 2).alias("overall_score"),
        ).withColumn("overall_classification", scoring.classify(F.col("overall_score"), "report")),
        RUN_HISTORY)


def dataset_history(scores: DataFrame, detail: DataFrame) -> DataFrame:
    """Scores per run and dataset with the number of critical columns.

    priority_index is our own measure: the distance to a perfect score, raised
    by the share of critical columns.
    """
    critical = detail.groupBy("run_id", "dataset_label").agg(
        F.count_if(class_value(detail) == "Crítico").alias("critical_columns_count"),
        F.count(F.lit(1)).alias("_columns"))
    joined = scores.withColumns({"score_overall": score_value(scores), "classification_overall": class_value(scores)}) \
        .join(critical, ["run_id", "dataset_label"], "left")
    crit = F.coalesce("critical_columns_count", F.lit(0))
    share = F.coalesce(F.try_divide(crit, F.col("_columns")), F.lit(0.0))
    renamed = {
        "run_timestamp": F.col("scanned_at"), "dataset_name": F.col("dataset_label"),
        "score_completeness": F.col("completude"), "score_consistency": F.col("consistencia"),
        "score_uniqueness": F.col("unicidade"), "score_validity": F.col("validade"),
        "score_timeliness": F.col("freshness"), "score_integrity": F.col("integridade"),
        "priority_index": scoring.exact_round((10 - F.col("score_overall")) * (1 + share), 4), "critical_columns_count": crit,
    }
    return align(joined.withColumns(renamed), DATASET_HISTORY)


def dimension_history(scores: DataFrame) -> DataFrame:
    keyed = scores.withColumns({"run_timestamp": F.col("scanned_at"), "dataset_name": F.col("dataset_label")})
    return align(to_long(keyed, ["run_id", "run_timestamp", "dataset_name"],
                         name="dimension_name", value="dimension_score"), DIMENSION_HISTORY)


def recommendation_history(scores: DataFrame, detail: DataFrame, detail_score: str = "score") -> DataFrame:
    """A recommendation per critical column and per dataset short of 'Bom', with its priority.

    Severity is the distance of the score to 10, business impact the same for the
    dataset, criticality 5 for the class Crítico and 3 otherwise. Owner and effort
    have no source and stay null.
    """
    advised = lowest_dimension_advice(scores).where(class_value(scores).isin("Crítico", "Atenção"))
    table_level = advised.select(
        "run_id", F.col("scanned_at").alias("run_timestamp"), F.col("dataset_label").alias("dataset_name"),
        F.lit("").alias("column_name"), F.lit("dataset").alias("recommendation_level"),
        F.col("lowest_dimension").alias("recommendation_type"), F.col("root_cause").alias("root_cause_hypothesis"),
        F.col("recommendation").alias("recommendation_text"),
        _priority(class_value(scores), score_value(scores)).alias("priority_score"))
    critical = detail.where(class_value(detail) == "Crítico")
    column_level = critical.select(
        "run_id", F.col("scanned_at").alias("run_timestamp"), F.col("dataset_label").alias("dataset_name"),
        "column_name", F.lit("column").alias("recommendation_level"), F.lit("Revisão").alias("recommendation_type"),
        F.lit(C.ADVICE_DEFAULT[0]).alias("root_cause_hypothesis"),
        F.format_string(C.REVIEW_TEXT, "column_name", "dataset_label").alias("recommendation_text"),
        _priority(F.lit("Crítico"), F.col(detail_score)).alias("priority_score"))
    rows = table_level.unionByName(column_level)
    return align(rows.withColumns({
        "recommendation_id": F.sha2(F.concat_ws(
            "|", "run_id", "dataset_name", "column_name", "recommendation_type"), 256),
        "priority_band": scoring.priority_band(F.col("priority_score")),
    }), RECOMMENDATIONS)


def _priority(klass, score):
    gap = F.floor(10 - score).cast("int")
    return scoring.priority_score(F.when(klass == "Crítico", 5).otherwise(3), gap, gap).cast("double")


def recommendation_view(recs: DataFrame, columns: Sequence[str] = (
        "dataset_name", "column_name", "priority_band", "priority_score", "recommendation_text",
        "owner_suggestion", "estimated_effort", "estimated_impact")) -> DataFrame:
    """The columns a reader sees, most urgent first."""
    return recs.orderBy(F.col("run_timestamp").desc(), F.col("priority_score").desc(), "dataset_name",
                        "column_name").select(*columns)
