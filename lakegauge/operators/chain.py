"""Score chain built on profile numbers alone: table score, column score, rule penalty, dimensions.

Input is a profile whose rows carry the key columns run_id, source_type,
source_ref and object_name; each step is a relation over a few rows per dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators.rules import estimate_violations

KEYS = ("run_id", "source_type", "source_ref", "object_name")
DIM_COLUMNS = ("dim_completude", "dim_unicidade", "dim_consistencia", "dim_validade",
               "dim_integridade_ref", "dim_freshness")


def table_scores(p: DataFrame, *keys: str) -> DataFrame:
    """0.6 completeness + 0.3 mean distinct ratio + 0.1 volume, per dataset.

    Metrics and mean ratio share the grouping, so one aggregate serves both.
    """
    keys = keys or KEYS
    completeness = (1 - F.coalesce("null_rate", F.lit(1.0))) * 10
    metrics = p.groupBy(*keys).agg(
        F.max("total").alias("sample_rows"),
        cells.ratio(F.sum("nulls"), F.sum("total")).alias("null_rate"),
        F.coalesce(F.avg("distinct_ratio"), F.lit(0.0)).alias("avg_distinct_ratio"))
    scores = metrics.withColumns({
        "score_completeness": completeness,
        "score_uniqueness": F.col("avg_distinct_ratio") * 10,
        "score_volume": scoring.volume_score(F.col("sample_rows")),
    })
    return scores.withColumn("score_final", scoring.clamp10(
        scoring.weighted({c: F.col(c) for c in C.TABLE_WEIGHTS}, C.TABLE_WEIGHTS)))


def column_scores(p: DataFrame, rules: DataFrame, zero_null_bug: bool = False) -> DataFrame:
    """Base score of every column, estimated violations, penalty and final score.

    zero_null_bug: treat a null rate of exactly 0 as 1, as a falsy-zero slip in
    older scanners does, so that perfect columns get no completeness.
    """
    rate = F.coalesce("null_rate", F.lit(1.0))
    if zero_null_bug:
        rate = F.when(rate == 0, 1.0).otherwise(rate)
    base = scoring.clamp10(C.COLUMN_WEIGHTS["completeness"] * ((1 - rate) * 10)
                           + C.COLUMN_WEIGHTS["uniqueness"] * (F.coalesce("distinct_ratio", F.lit(0.0)) * 10))
    return (estimate_violations(p, rules)
            .withColumn("score_base", base)
            .withColumn("score_rules", scoring.rule_penalty(F.col("violations"), F.col("total")))
            .withColumn("score_final", scoring.clamp10(F.col("score_base") + F.col("score_rules"))))


def table_scores_with_rules(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Table score lowered by the mean penalty of its columns."""
    penalties = columns.groupBy("run_id", "object_name").agg(F.avg("score_rules").alias("rules_penalty_avg"))
    return (tables.withColumnRenamed("score_final", "score_base")
            .join(penalties, ["run_id", "object_name"], "left")
            .withColumn("rules_penalty_avg", F.coalesce("rules_penalty_avg", F.lit(0.0)))
            .withColumn("score_final", scoring.clamp10(F.col("score_base") + F.col("rules_penalty_avg")))
            .select(*[k for k in KEYS if k in tables.columns], "score_base", "rules_penalty_avg", "score_final"))


def dimension_table(tables: DataFrame, columns: DataFrame, with_rules: DataFrame | None = None) -> DataFrame:
    """Six dimensions per dataset out of table and column scores.

    The final note is weighted from the dimensions, or taken from `with_rules` when given.
    """
    means = columns.groupBy("run_id", "object_name").agg(
        F.avg("score_final").alias("c_final"), F.avg("score_base").alias("c_base"), F.avg("score_rules").alias("c_rules"))
    keys = [k for k in KEYS if k in tables.columns]

    def or_zero(name: str):
        return F.coalesce(F.col(name), F.lit(0.0))

    dims = tables.join(means, ["run_id", "object_name"], "left").select(
        *keys,
        or_zero("score_completeness").alias("dim_completude"), or_zero("score_uniqueness").alias("dim_unicidade"),
        or_zero("c_final").alias("dim_consistencia"), or_zero("c_base").alias("dim_validade"),
        scoring.clamp10(10 + or_zero("c_rules")).alias("dim_integridade_ref"), F.lit(0.0).alias("dim_freshness"))
    if with_rules is None:
        columns_of = dict(zip(("completude", "unicidade", "consistencia", "validade", "integridade", "freshness"),
                              DIM_COLUMNS))
        note = scoring.clamp10(scoring.weighted({d: F.col(c) for d, c in columns_of.items()}, C.WEIGHTS["star"]))
        return dims.withColumn("score_final", note)
    official = with_rules.select("run_id", "object_name", F.col("score_final"))
    return dims.join(official, ["run_id", "object_name"], "left").select(
        *keys, *DIM_COLUMNS, or_zero("score_final").alias("score_final"))
