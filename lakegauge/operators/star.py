"""Scan of a described fact table: required columns, key, rules, parent table, load time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators.profile import quoted
from lakegauge.operators.rules import orphan_count, violation_score
from lakegauge.operators.uniqueness import key_uniqueness


@dataclass(frozen=True)
class StarSpec:
    key: str
    required: Sequence[str]
    invalid: Column = field(compare=False)
    start: str = ""
    end: str = ""
    parent_key: str = ""
    foreign_key: str = ""
    loaded_at: str = ""
    sla_hours: float = C.SLA_HOURS


def freshness(df: DataFrame, column: str, as_of, sla_hours: float = C.SLA_HOURS) -> DataFrame:
    """Age in hours of the latest value, and its score against the SLA."""
    age = (cells.epoch_seconds(cells.moment(as_of)) - cells.epoch_seconds(F.max(quoted(column)))) / 3600.0
    return df.agg(age.alias("age_hours")).withColumn("score", scoring.score10(1 - F.col("age_hours") / sla_hours))


def star_scan(fact: DataFrame, parent: DataFrame, spec: StarSpec, as_of) -> DataFrame:
    """total, the six dimensions (unrounded) and the final note, one row.

    Three aggregates (fact, key groups, orphans) give one partial row each; the
    partial rows are merged by max, so nothing is joined back.
    """
    total = F.count(F.lit(1))
    types = {f.name: f.dataType for f in fact.schema.fields}
    nulls = sum((F.count_if(cells.is_missing(quoted(c), types[c])) for c in spec.required[1:]),
                F.count_if(cells.is_missing(quoted(spec.required[0]), types[spec.required[0]])))
    late = F.coalesce(quoted(spec.start) > quoted(spec.end), F.lit(False))
    age = (cells.epoch_seconds(cells.moment(as_of)) - cells.epoch_seconds(F.max(quoted(spec.loaded_at)))) / 3600.0
    main = fact.agg(
        total.alias("total"), nulls.alias("null_cells"),
        F.count_if(F.coalesce(spec.invalid, F.lit(False))).alias("invalid"), F.count_if(late).alias("late"),
        age.alias("age_hours"))
    keys = key_uniqueness(fact, [spec.key]).select("distinct_keys")
    orphans = orphan_count(fact, spec.foreign_key, parent, spec.parent_key).select(F.col("violations").alias("orphans"))
    merged = (main.unionByName(keys, allowMissingColumns=True).unionByName(orphans, allowMissingColumns=True)
              .agg(*[F.max(c).alias(c) for c in
                     ("total", "null_cells", "invalid", "late", "age_hours", "distinct_keys", "orphans")]))
    n = F.col("total")
    return merged.select(
        "total",
        violation_score(F.col("null_cells") / len(spec.required), n).alias("completude"),
        violation_score(n - F.col("distinct_keys"), n).alias("unicidade"),
        violation_score(F.col("late"), n).alias("consistencia"),
        violation_score(F.col("invalid"), n).alias("validade"),
        violation_score(F.col("orphans"), n).alias("integridade"),
        scoring.score10(1 - F.col("age_hours") / spec.sla_hours).alias("freshness"),
    ).withColumn("nota_final", scoring.exact_round(
        scoring.weighted({d: F.col(d) for d in C.DIMENSIONS}, C.WEIGHTS["star"]), 2))
