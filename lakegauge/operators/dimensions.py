"""Dimension scores from the profile table, and their wide and long forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells, scoring


def _parts() -> dict[str, Column]:
    """Aggregates over the profile rows of one dataset, unrounded, empty tables aside."""
    total, nulls = F.col("total"), F.col("nulls")
    there = total - nulls
    unique = F.when(there == 0, 1.0).otherwise(F.col("distinct_ratio"))
    is_text = ~F.col("kind").isin("numeric", "temporal")
    useful = F.when((there == 0) | ~is_text, 1.0).otherwise(F.col("non_blank") / there)
    # several value types in one column cost a quarter each
    types = F.greatest(F.coalesce("type_count", F.lit(1)), F.lit(1))
    uniform = F.when(there == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (types - 1) * 0.25))
    id_like, date_like = F.col("column_name").rlike(C.ID_PATTERN), F.col("column_name").rlike(C.DATE_PATTERN)
    keyed = F.when(id_like, (cells.ratio(there, total) + F.col("distinct_ratio")) / 2)
    dated = F.when(date_like, cells.ratio(
        F.when(F.col("kind") == "temporal", there).otherwise(F.coalesce("parse_ok", F.lit(0))), total))
    completeness = scoring.score10(1 - F.sum("nulls") / F.nullif(F.sum("total"), F.lit(0)))
    uniqueness = scoring.score10(F.avg(unique))
    return {
        "completude": completeness,
        "unicidade": uniqueness,
        "consistencia": scoring.score10(F.avg(uniform)),
        "validade": scoring.score10(F.avg(useful)),
        "integridade": F.when(F.count(keyed) > 0, scoring.score10(F.avg(keyed)))
                        .otherwise(scoring.clamp10((completeness + uniqueness) / 2)),
        "freshness": F.when(F.count(dated) > 0, scoring.score10(F.max(dated))).otherwise(5.0),
    }


def dimension_scores(p: DataFrame, *keys: str, only: Sequence[str] = C.DIMENSIONS) -> DataFrame:
    """The six table dimensions, four decimals, with row and column counts.

    Empty tables score 0 throughout, and 5 for freshness.
    """
    rows = F.max("total")
    parts = _parts()
    empty = {d: 5.0 if d == "freshness" else 0.0 for d in C.DIMENSIONS}
    return p.groupBy(*keys).agg(
        rows.alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        *[scoring.exact_round(F.when(rows > 0, parts[d]).otherwise(empty[d]), 4).alias(d) for d in only])


def column_dimension_scores(p: DataFrame) -> DataFrame:
    """The six column dimensions; a projection, nothing is shuffled."""
    fill, unique = scoring.score10(1 - F.col("null_rate")), scoring.score10(F.col("distinct_ratio"))
    return p.withColumns({
        "completude": scoring.exact_round(fill, 4),
        "unicidade": scoring.exact_round(unique, 4),
        "consistencia": F.lit(10.0),
        "validade": F.when((F.col("total") == 0) | (F.col("nulls") < F.col("total")), 10.0).otherwise(0.0),
        "integridade": scoring.exact_round(scoring.clamp10(
            ((1 - F.col("null_rate")) * 10 + F.col("distinct_ratio") * 10) / 2), 4),
        "freshness": F.lit(5.0),
    })


def scored(dims: DataFrame, weights: str = "scan", bands: str = "scan", digits: int = 4) -> DataFrame:
    """Adds score and classification to rows holding the six dimensions."""
    return dims.withColumn("score", scoring.overall_score(weights, digits)) \
        .withColumn("classification", scoring.classify(F.col("score"), bands))


def to_long(dims: DataFrame, keys: Sequence[str], columns: Sequence[str] = C.DIMENSIONS,
            name: str = "dimension", value: str = "score") -> DataFrame:
    return dims.unpivot(list(keys), list(columns), name, value)


def to_wide(long: DataFrame, keys: Sequence[str], columns: Sequence[str] = C.DIMENSIONS,
            name: str = "dimension", value: str = "score") -> DataFrame:
    """Mean per dimension as columns; naming the columns saves a job that looks for them."""
    return long.groupBy(*keys).pivot(name, list(columns)).agg(F.avg(value))


def dimension_averages(dims: DataFrame, columns: Sequence[str] = C.DIMENSIONS) -> DataFrame:
    """Mean of every dimension over all rows, as (dimension, score)."""
    means = dims.agg(*[F.avg(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))).alias(c) for c in columns])
    return to_long(means, [], columns)


def weighted_dimensions(long: DataFrame, weights: Mapping[str, float], *keys: str) -> DataFrame:
    """Sum over the dimensions present, divided by the sum of all weights."""
    weight = scoring.lookup(F.col("dimension"), {k: str(v) for k, v in weights.items()}).cast("double")
    total = float(sum(weights.values()))
    return long.groupBy(*keys).agg((F.sum(F.col("score") * weight) / F.lit(total)).alias("score"))


def weighted_mean(df: DataFrame, score: str, weight: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(weight)).alias("score"))
