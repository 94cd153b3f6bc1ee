"""The profile table: one row per column of a dataset.

Plain aggregates run in one pass per chunk of columns (a chunk keeps the
generated code small, and each chunk reads only its own columns). Exact
distinct counts are taken apart from them: cells are stacked to (column, key)
and grouped, so repeated values combine before the shuffle, a hot value is
spread over all tasks of the first stage, and one column never lands in one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import cells

CHUNK = 8
_DIGEST_FROM = 64

PROFILE = T.StructType([
    T.StructField("ordinal", T.IntegerType()), T.StructField("column_name", T.StringType()),
    T.StructField("dtype", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("total", T.LongType()), T.StructField("nulls", T.LongType()),
    T.StructField("null_rate", T.DoubleType()), T.StructField("distinct_cnt", T.LongType()),
    T.StructField("distinct_ratio", T.DoubleType()), T.StructField("min_value", T.StringType()),
    T.StructField("max_value", T.StringType()), T.StructField("avg_len", T.DoubleType()),
    T.StructField("max_len", T.LongType()), T.StructField("non_blank", T.LongType()),
    T.StructField("parse_ok", T.LongType()), T.StructField("type_count", T.IntegerType()),
])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def short_key(text: Column) -> Column:
    """Text shorter than 64 bytes as it is, longer text by its SHA-256 (64 hex digits).

    The two never meet, and no shuffled key is longer than 64 bytes.
    """
    return F.when(F.octet_length(text) < _DIGEST_FROM, text).otherwise(F.sha2(text, 256))


def is_fixed_width(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType,
                                  T.TimestampType, T.TimestampNTZType))


def _cell_key(ordinal: int, c: Column, data_type: T.DataType) -> Column:
    """(ordinal, word, text) of a present cell, null of a missing one.

    Numbers, dates and booleans become one 64-bit word: XXH64 of a single word only
    multiplies by odd numbers, rotates and xors, so it maps words one to one and two
    values never share a key (both zeros do, as they should). Anything else is text.
    """
    if is_fixed_width(data_type):
        value = cells.present(c, data_type)
        word, text = F.xxhash64(value), F.lit(None).cast("string")
    else:
        value = c
        word, text = F.lit(None).cast("bigint"), short_key(cells.as_text(c, data_type))
    return F.when(value.isNotNull(), F.struct(
        F.lit(ordinal).alias("ordinal"), word.alias("word"), text.alias("text")))


def cell_keys(df: DataFrame, ordinals: Sequence[int] | None = None) -> DataFrame:
    """(ordinal, word, text) of every present cell of the chosen columns."""
    keys = [_cell_key(i, quoted(f.name), f.dataType) for i, f in enumerate(df.schema.fields)
            if ordinals is None or i in ordinals]
    chunks = [df.select(F.inline(F.array(*keys[at:at + CHUNK]))).where(F.col("ordinal").isNotNull())
              for at in range(0, len(keys), CHUNK)]
    return reduce(DataFrame.unionAll, chunks)


def distinct_counts(keys: DataFrame, *by: str) -> DataFrame:
    """Exact distinct values per column of a `cell_keys` table: (*by, ordinal, distinct_cnt)."""
    return keys.distinct().groupBy(*by, "ordinal").agg(F.count(F.lit(1)).alias("distinct_cnt"))


def json_kind(text: Column) -> Column:
    """Top-level type of a text read as JSON; text that is no JSON is plain text."""
    schema = F.schema_of_variant(F.try_parse_json(text))
    return F.coalesce(F.regexp_extract(schema, "^([A-Z]+)", 1), F.lit("TEXT"))


def chunked(weights: Sequence[int], limit: int = CHUNK) -> list[range]:
    """Runs of neighbouring items of a weight of at most `limit` together, or a single heavier one."""
    out, start, total = [], 0, 0
    for i, w in enumerate(weights):
        if i > start and total + w > limit:
            out.append(range(start, i))
            start, total = i, 0
        total += w
    return out + [range(start, len(weights))] if weights else []


def _column_aggregates(field: T.StructField, ordinal: int, lexical: bool, extra: Sequence[Column] | None) -> Column:
    c, dt = quoted(field.name), field.dataType
    kind = cells.kind_of(dt)
    value = cells.present(c, dt)
    none = F.lit(None)
    low = high = avg_len = max_len = non_blank = parse_ok = types = none
    if kind in ("numeric", "temporal"):
        low, high = F.min(value), F.max(value)
    else:
        text = cells.as_text(c, dt)
        avg_len, max_len = F.avg(F.char_length(text)), F.max(F.char_length(text))
        non_blank = F.count_if(cells.not_blank(text))
        if kind == "text" and re.search(C.DATE_PATTERN, field.name):
            parse_ok = F.count(cells.parse_datetime(c, dt))
        if kind == "text" and lexical:
            types = F.size(F.collect_set(json_kind(text)))
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(field.name).alias("column_name"),
        F.lit(dt.simpleString()).alias("dtype"), F.lit(kind).alias("kind"),
        F.count(F.lit(1)).alias("total"), F.count(value).alias("present"),
        low.cast("string").alias("min_value"), high.cast("string").alias("max_value"),
        avg_len.cast("double").alias("avg_len"), max_len.cast("bigint").alias("max_len"),
        non_blank.cast("bigint").alias("non_blank"), parse_ok.cast("bigint").alias("parse_ok"),
        types.cast("int").alias("type_count"),
        *([] if extra is None else [F.array(*extra).alias("extra")]),
    )


def _sketched(df: DataFrame, log_buckets: int) -> DataFrame:
    """Approximate distinct values per column: (ordinal, distinct_cnt)."""
    chunks = []
    fields = list(enumerate(df.schema.fields))
    for at in range(0, len(fields), CHUNK):
        counts = []
        for i, f in fields[at:at + CHUNK]:
            c = quoted(f.name)
            value = cells.present(c, f.dataType)
            key = F.when(value.isNotNull(), F.xxhash64(value)) if is_fixed_width(f.dataType) \
                else cells.as_text(c, f.dataType)
            counts.append(F.struct(F.lit(i).alias("ordinal"), F.hll_sketch_estimate(
                F.hll_sketch_agg(key, log_buckets)).alias("distinct_cnt")))
        chunks.append(df.agg(F.array(*counts).alias("cols")).select(F.inline("cols")))
    return reduce(DataFrame.unionAll, chunks)


def profile(df: DataFrame, distinct: str = "exact", lexical: bool = False, log_buckets: int = 12) -> DataFrame:
    """One row per column: counts, null rate, distincts, range or text lengths.

    distinct: 'exact', 'approx' (HyperLogLog sketches, nothing else is shuffled;
    12 bits of buckets err by about 1.6 %) or 'none'. lexical: also count the JSON
    kinds found in text columns. Columns named like dates get the number of readable ones.
    """
    return profiles([({}, df)], distinct, lexical, log_buckets)


def profiles(tables: Sequence[tuple[Mapping[str, Column], DataFrame]], distinct: str = "exact", lexical: bool = False,
             log_buckets: int = 12, extras: Sequence[Mapping[int, Sequence[Column]]] | None = None, none: Column | None = None) -> DataFrame:
    """Profiles of several tables, each behind the literal columns given with it.

    All tables share one shuffle of distinct values, so many small tables cost no
    more stages than one. `extras` are further aggregates, for each table those of its columns by ordinal, all of the type
    of `none`: they are taken in the same reading as the profile of their column and come as an array `extra`.
    """
    plain, counted = [], []
    for n, (labels, df) in enumerate(tables):
        fields = df.schema.fields
        number = F.lit(n).alias("_table")
        more = [None if extras is None else list(extras[n].get(i, ())) for i in range(len(fields))]
        for run in chunked([1 + len(m or ()) for m in more]):
            structs = [_column_aggregates(fields[i], i, lexical, None if extras is None else more[i] or [none]) for i in run]
            part = df.agg(F.array(*structs).alias("cols")).select(F.inline("cols"))
            plain.append(part.select(number, *[v.alias(k) for k, v in labels.items()], "*"))
        if fields and distinct == "exact":
            counted.append(cell_keys(df).select(number, "*"))
        elif fields and distinct == "approx":
            counted.append(_sketched(df, log_buckets).select(number, "*"))
    if not plain:
        return tables[0][1].sparkSession.createDataFrame([], PROFILE)
    out = reduce(DataFrame.unionAll, plain)
    if counted:
        counts = reduce(DataFrame.unionAll, counted)
        if distinct == "exact":
            counts = distinct_counts(counts, "_table")
        # one row per column on both sides: as small as the schemas are wide
        out = out.join(F.broadcast(counts), ["_table", "ordinal"], "left")
        count = F.coalesce("distinct_cnt", F.lit(0).cast("bigint"))
    else:
        count = F.lit(None).cast("bigint")
    return finished(out, count, *tables[0][0])


def finished(out: DataFrame, count: Column, *labels: str) -> DataFrame:
    """The profile table from counts of present cells, ranges as text and the number of distinct values."""
    total, there = F.col("total"), F.col("present")

    def shown(name: str) -> Column:
        value = F.col(name)
        return (F.when(F.col("dtype").isin("float", "double"), cells.as_text(value.cast("double"), T.DoubleType()))
                .when(F.col("dtype") == "boolean", F.initcap(value)).otherwise(value).alias(name))

    return out.select(
        *labels, "ordinal", "column_name", "dtype", "kind", "total",
        (total - there).alias("nulls"), cells.ratio(total - there, total).alias("null_rate"),
        count.alias("distinct_cnt"),
        # an estimated count may exceed the cells there are
        F.when(count.isNotNull(), cells.ratio(F.least(count, there), there)).alias("distinct_ratio"),
        shown("min_value"), shown("max_value"), "avg_len", "max_len", "non_blank", "parse_ok", "type_count",
        *(["extra"] if "extra" in out.columns else []),
    )


def table_metrics(p: DataFrame, *keys: str) -> DataFrame:
    """Rows, columns, null and total cells, null rate and mean fill rate from a profile."""
    cells_total = F.sum("total")
    return p.groupBy(*keys).agg(
        F.max("total").alias("sample_rows"), F.count(F.lit(1)).alias("columns"),
        F.sum("nulls").alias("null_cells"), cells_total.alias("total_cells"),
        cells.ratio(F.sum("nulls"), cells_total).alias("null_rate"),
        F.avg(1 - F.col("null_rate")).alias("mean_fill_rate"),
    )


def avg_distinct_ratio(p: DataFrame, *keys: str) -> DataFrame:
    return p.groupBy(*keys).agg(F.avg("distinct_ratio").alias("avg_distinct_ratio"))


def value_counts(df: DataFrame, column: str, name: str = "quantidade") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def looks_like_pasted_csv(df: DataFrame) -> DataFrame:
    """One row (pasted boolean): a single column in which enough values hold three commas."""
    if len(df.columns) != 1:
        return df.sparkSession.createDataFrame([(False,)], "pasted boolean")
    text = quoted(df.columns[0]).cast("string")
    commas = F.char_length(text) - F.char_length(F.translate(text, ",", ""))
    share = F.avg(F.when(commas >= C.PASTED_CSV_COMMAS, 1.0).when(text.isNotNull(), 0.0))
    return df.agg(F.coalesce(share >= C.PASTED_CSV_SHARE, F.lit(False)).alias("pasted"))
