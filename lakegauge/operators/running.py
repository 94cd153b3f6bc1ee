"""A profile that grows with its table: what is kept of the rows seen so far, and how new rows are added to it.

The state has one row per column: counts, ranges, lengths and, for approximate distincts, a HyperLogLog sketch. States of
disjoint rows merge into that of all rows. Exact distincts keep the keys seen so far beside the state, and new rows only
add the keys that are not there yet, so no row is read twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import cells
from lakegauge.operators.profile import CHUNK, finished, is_fixed_width, json_kind, quoted

STATE = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("present", T.LongType()),
    T.StructField("low", T.StringType()), T.StructField("high", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("texts", T.LongType()), T.StructField("max_len", T.LongType()), T.StructField("non_blank", T.LongType()),
    T.StructField("parse_ok", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType())),
    T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.LongType()),
])
KEYS = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("text", T.StringType())])


def _kept(value: Column, data_type: T.DataType) -> Column:
    """A bound as text from which it can be read back exactly; moments as microseconds, whatever the session's zone."""
    return (F.unix_micros(value) if isinstance(data_type, T.TimestampType) else value).cast("string")


def _read(text: Column, data_type: T.DataType) -> Column:
    return F.timestamp_micros(text.cast("bigint")) if isinstance(data_type, T.TimestampType) else text.cast(data_type)


def _chunked(df: DataFrame, fields: Sequence[T.StructField], aggregates: Callable[[int, T.StructField], dict[str, Column]]) -> DataFrame:
    parts = []
    for at in range(0, len(fields), CHUNK):
        structs = [F.struct(*[v.cast(STATE[k].dataType).alias(k) for k, v in aggregates(at + i, f).items()]) for i, f in enumerate(fields[at:at + CHUNK])]
        parts.append(df.agg(F.array(*structs).alias("cols")).select(F.inline("cols")))
    return reduce(DataFrame.unionAll, parts)


def measured(df: DataFrame, lexical: bool = False, sketches: bool = False, log_buckets: int = 12) -> DataFrame:
    """The state of some rows; `keys` is left 0."""
    none = F.lit(None)

    def aggregates(i: int, field: T.StructField) -> dict[str, Column]:
        c, dt = quoted(field.name), field.dataType
        kind, value = cells.kind_of(dt), cells.present(c, dt)
        out = {f.name: none for f in STATE.fields} | {
            "ordinal": F.lit(i), "total": F.count(F.lit(1)), "present": F.count(value), "keys": F.lit(0)}
        text = cells.as_text(c, dt)
        if kind in ("numeric", "temporal"):
            out |= {"low": _kept(F.min(value), dt), "high": _kept(F.max(value), dt)}
        else:
            out |= {"length": F.sum(F.char_length(text)), "texts": F.count(text), "max_len": F.max(F.char_length(text)),
                    "non_blank": F.count_if(cells.not_blank(text))}
            if kind == "text" and re.search(C.DATE_PATTERN, field.name):
                out["parse_ok"] = F.count(cells.parse_datetime(c, dt))
            if kind == "text" and lexical:
                out["kinds"] = F.collect_set(json_kind(text))
        if sketches:
            key = F.when(value.isNotNull(), F.xxhash64(value)) if is_fixed_width(dt) else text
            out["sketch"] = F.hll_sketch_agg(key, log_buckets)
        return out

    return _chunked(df, df.schema.fields, aggregates)


def merged(states: DataFrame, schema: T.StructType) -> DataFrame:
    """One state from the states of disjoint rows of a table with the given columns."""
    def aggregates(i: int, field: T.StructField) -> dict[str, Column]:
        def own(name: str) -> Column:
            return F.when(F.col("ordinal") == i, F.col(name))

        dt, bounded = field.dataType, cells.kind_of(field.dataType) in ("numeric", "temporal")
        none = F.lit(None)
        out = {"ordinal": F.lit(i)} | {k: F.sum(own(k)) for k in ("total", "present", "length", "texts", "non_blank", "parse_ok", "keys")} | {
            "low": _kept(F.min(_read(own("low"), dt)), dt) if bounded else none,
            "high": _kept(F.max(_read(own("high"), dt)), dt) if bounded else none,
            "max_len": F.max(own("max_len")),
            "kinds": F.when(F.count(own("kinds")) > 0, F.array_distinct(F.flatten(F.collect_list(own("kinds"))))),
            "sketch": F.when(F.count(own("sketch")) > 0, F.hll_union_agg(own("sketch")))}
        return {f.name: out[f.name] for f in STATE.fields}

    return _chunked(states, schema.fields, aggregates)


def new_keys(found: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct keys of new rows (see `profile.cell_keys`) that are not known yet."""
    fresh, seen = found.distinct().alias("f"), known.alias("k")
    same = (F.col("f.ordinal") == F.col("k.ordinal")) & F.col("f.word").eqNullSafe(F.col("k.word")) & F.col("f.text").eqNullSafe(F.col("k.text"))
    return fresh.join(seen, same, "left_anti")


def with_keys(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """The state with the number of new keys of each column added to those it had."""
    more = fresh.groupBy("ordinal").agg(F.count(F.lit(1)).alias("more"))
    return state.join(F.broadcast(more), "ordinal", "left").withColumn("keys", F.col("keys") + F.coalesce("more", F.lit(0))).select(*STATE.fieldNames())


def profile_of(state: DataFrame, schema: T.StructType, distinct: str = "exact") -> DataFrame:
    """The profile of all rows that the state has seen, in the layout of `profile`."""
    names = [(i, f.name, f.dataType.simpleString(), cells.kind_of(f.dataType)) for i, f in enumerate(schema.fields)]
    columns = state.sparkSession.createDataFrame(names, "ordinal int, column_name string, dtype string, kind string")
    rows = state.join(F.broadcast(columns), "ordinal")
    moment = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
    for name, bound in (("min_value", "low"), ("max_value", "high")):
        text = F.col(bound)
        rows = rows.withColumn(name, F.when(F.col("column_name").isin(moment), F.timestamp_micros(text.try_cast("bigint")).cast("string")).otherwise(text) if moment else text)
    rows = rows.withColumns({"avg_len": F.col("length").cast("double") / F.nullif(F.col("texts"), F.lit(0)), "type_count": F.size("kinds")})
    rows = rows.withColumn("type_count", F.when(F.col("kinds").isNotNull(), F.col("type_count")))
    count = {"exact": F.col("keys"), "approx": F.when(F.col("sketch").isNotNull(), F.hll_sketch_estimate("sketch")), "none": F.lit(None).cast("bigint")}[distinct]
    return finished(rows, count)
