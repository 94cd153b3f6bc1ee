"""Uniqueness of whole rows and of keys, and completeness of required columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.functions import cells, scoring
from lakegauge.operators.profile import quoted, short_key


def row_identity(df: DataFrame, as_joined_text: bool = False) -> Column:
    """A short key that is equal for equal rows.

    The default keeps nulls, empty texts and column borders apart. The joined
    text form (cells with | between, null as '') confuses them, as some scanners do.
    """
    if as_joined_text:
        texts = [F.coalesce(cells.as_text(quoted(f.name), f.dataType), F.lit("")) for f in df.schema.fields]
        return short_key(F.concat_ws("|", *texts))
    parts = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if cells.kind_of(f.dataType) in ("text", "nested"):
            text = cells.as_text(c, f.dataType)
        elif cells.is_fractional(f.dataType):
            text = F.when(c == 0, "0").otherwise(c.cast("string"))  # both zeros are one value
        else:
            text = c.cast("string")
        # the length ahead keeps column borders apart
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text)))
    return F.unhex(F.sha2(F.concat_ws(",", *parts).cast("binary"), 256))


def row_uniqueness(df: DataFrame, as_joined_text: bool = False) -> DataFrame:
    """total, distinct_rows, dup_rate and the 0-10 score of whole-row uniqueness.

    Equal rows are counted together before the shuffle; one aggregate yields both
    the number of rows and of groups.
    """
    groups = df.select(row_identity(df, as_joined_text).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    total, distinct = F.col("total"), F.col("distinct_rows")
    return (groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct_rows"))
            .withColumn("dup_rate", F.when(total > 0, 1 - distinct / total))
            .withColumn("score", F.when(total > 0, scoring.score10(distinct / total)).otherwise(0.0)))


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct complete keys over all rows; no key or no rows scores 10."""
    if not keys:
        return df.agg(F.count(F.lit(1)).alias("total"), F.lit(None).cast("bigint").alias("distinct_keys"),
                      F.lit(10.0).alias("score"))
    complete = F.lit(True)
    for k in keys:
        complete = complete & quoted(k).isNotNull()
    groups = df.groupBy(*[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias("_n"), F.first(complete).alias("_complete"))
    return (groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
                       F.count_if("_complete").alias("distinct_keys"))
            .withColumn("score", F.when(F.col("total") > 0, scoring.score10(F.col("distinct_keys") / F.col("total")))
                        .otherwise(10.0)))


def required_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean null rate over the required columns; nothing required or no rows scores 10."""
    total = F.count(F.lit(1))
    if not columns:
        return df.agg(total.alias("total"), F.lit(0.0).alias("mean_null_rate"), F.lit(10.0).alias("score"))
    types = {f.name: f.dataType for f in df.schema.fields}
    nulls = [F.count_if(cells.is_missing(quoted(c), types[c])) for c in columns]
    rate = sum((n for n in nulls[1:]), nulls[0]) / F.nullif(total, F.lit(0)) / len(columns)
    return df.agg(total.alias("total"), F.coalesce(rate, F.lit(0.0)).alias("mean_null_rate")).withColumn(
        "score", scoring.score10(1 - F.col("mean_null_rate")))


def simple_table_score(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Mean of required-column completeness and key uniqueness, two decimals."""
    completeness = required_completeness(df, required).select(
        F.col("total"), F.col("score").alias("completude"), F.lit(None).cast("double").alias("unicidade"))
    uniqueness = key_uniqueness(df, keys).select(
        F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("double").alias("completude"),
        F.col("score").alias("unicidade"))
    return completeness.unionByName(uniqueness).agg(
        F.max("total").alias("total"), F.max("completude").alias("completude"),
        F.max("unicidade").alias("unicidade"),
    ).withColumn("nota_final", scoring.exact_round((F.col("completude") + F.col("unicidade")) / 2, 2))
