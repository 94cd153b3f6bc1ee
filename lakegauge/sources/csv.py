"""CSV reading with the missing-value texts and type guesses analysts expect, and CSV extracts."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import cells
from lakegauge.operators.profile import CHUNK, quoted
from lakegauge.session import work_path
from lakegauge.sources.datasets import Dataset, capped, file_meta

_TRUE_FALSE = "(?i:true|false)"
_WHOLE_ROW = "__whole_row"


def guess_separator(spark: SparkSession, path: str) -> str:
    """',' unless the first line holds more ';'."""
    line = spark.read.text(path).limit(1).agg(F.max("value").alias("line")).first().line or ""
    return ";" if line.count(";") > line.count(",") else ","


def _typed(c: Column, tag: str) -> Column:
    text = cells.strip(c)
    if tag == "bigint":
        return text.try_cast("bigint")
    if tag == "double":
        return cells.float_of_text(c)
    if tag == "boolean":
        return F.lower(text) == "true"
    return c


def _type_tag(c: Column) -> Column:
    """The narrowest of bigint, double, boolean and string that reads every text of a column; an aggregate."""
    there = F.count(c)
    whole = F.count_if(cells.matches_stripped(c, r"[+-]?\d+") & cells.strip(c).try_cast("bigint").isNotNull())
    return (F.when(there == 0, "double").when(whole == there, "bigint")
            .when(F.count_if(cells.is_float_text(c)) == there, "double")
            .when(F.count_if(cells.matches_stripped(c, _TRUE_FALSE)) == there, "boolean").otherwise("string"))


def guess_types(df: DataFrame) -> dict[str, str]:
    """Type per text column, from all rows: bigint, double, boolean or string. One job, whatever the number of columns."""
    parts = []
    for at in range(0, len(df.columns), CHUNK):
        checks = [_type_tag(quoted(name)) for name in df.columns[at:at + CHUNK]]
        parts.append(df.agg(F.array(*checks).alias("tags")).select(F.lit(at).alias("at"), "tags"))
    tags: dict[str, str] = {}
    for row in (reduce(DataFrame.unionAll, parts).collect() if parts else ()):
        tags.update(zip(df.columns[row["at"]:row["at"] + CHUNK], row.tags))
    return tags


def scan_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", limit: int | None = None,
             schema: T.StructType | None = None, multiline: bool = False, stage: str | None = None) -> Dataset:
    """Header CSV as typed columns.

    The file is parsed once, into a Parquet copy (below `stage`, by default a fresh working folder) that everything else
    reads: types, profile, rules. So a row cap keeps the same rows throughout. Cells are read as text, the usual
    spellings of "missing" become null, and types are guessed from all rows unless a schema is given. A row with more
    fields than the header is an error; absent fields are null. Files stay splittable unless `multiline` admits line
    breaks inside quotes.
    """
    if sep == "auto":
        sep = guess_separator(spark, path)

    def reader():
        return (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
                .option("quote", '"').option("escape", '"').option("multiLine", multiline))

    names = reader().csv(path).columns
    layout = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _WHOLE_ROW]])
    raw = reader().schema(layout).option("columnNameOfCorruptRecord", _WHOLE_ROW).option("columnPruning", False).csv(path)
    copy = stage or work_path(spark, "csv")
    capped(raw, limit).write.mode("overwrite").parquet(copy)
    raw = spark.read.schema(layout).parquet(copy)
    fields = F.regexp_count(F.regexp_replace(_WHOLE_ROW, r'"([^"]|"")*"', ""), F.lit(re.escape(sep))) + 1
    surplus = raw.where(F.col(_WHOLE_ROW).isNotNull() & (fields > len(names))).count()
    if surplus:
        raise ValueError(f"{surplus} rows have more than {len(names)} fields")
    nulled = raw.select(*[F.when(~quoted(c).isin(*C.NA_TOKENS), quoted(c)).alias(c) for c in names])
    if schema is not None:
        df = nulled.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    else:
        tags = guess_types(nulled)
        df = nulled.select(*[_typed(quoted(c), tags[c]).alias(c) for c in nulled.columns])
    meta = file_meta(path)
    return Dataset(meta["dataset_name"], df, meta)


def header_names(line: str, sep: str) -> list[str]:
    """Column names of a header line; blank ones are numbered, repeated ones (in any case) get their place behind them."""
    found = next(csv.reader([line], delimiter=sep, quotechar='"', doublequote=True), [])
    seen = Counter(n.lower() for n in found)
    return [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(found)]


def first_lines(spark: SparkSession, paths: Sequence[str], encoding: str = "utf-8") -> dict[str, str]:
    """File name -> its first line that is not empty, for all files by one job."""
    rows = spark.read.option("encoding", encoding).text(list(paths)).select(
        _file_name().alias("name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    first = rows.where((F.col("start") == 0) & (F.col("value") != "")).groupBy("name").agg(F.min_by("value", "row").alias("line"))
    return {r["name"]: r["line"] for r in first.collect()}


def _file_name() -> Column:
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def scan_csv_files(spark: SparkSession, paths: Mapping[str, str], sep: str = ",", encoding: str = "utf-8"
                   ) -> dict[str, Dataset | str]:
    """Many CSV files of one folder, file name -> path, each as a typed dataset or the reason why it is none.

    Header lines are read by one job. Files with as many columns are parsed together, by position, into one Parquet copy
    with a folder per file, and their types are guessed together; so the number of jobs depends on how many widths there
    are, not on how many files. If a group fails, its files are read one by one.
    """
    out: dict[str, Dataset | str] = {}
    groups: dict[tuple[str, int], dict[str, list[str]]] = {}
    lines = first_lines(spark, list(paths.values()), encoding) if paths else {}
    for name in paths:
        line = lines.get(name, "")
        own = (";" if line.count(";") > line.count(",") else ",") if sep == "auto" else sep
        names = header_names(line, own)
        groups.setdefault((own, len(names)), {})[name] = names
    for (own, width), headers in groups.items():
        chosen = {n: paths[n] for n in headers}
        try:
            if not width:
                raise ValueError("no header")
            out.update(_scan_group(spark, chosen, headers, own, encoding))
        except Exception:  # one of them cannot be read
            for name, path in chosen.items():
                try:
                    out[name] = scan_csv(spark, path, own, encoding)
                except Exception as error:
                    out[name] = str(error).splitlines()[0]
    return out


def _scan_group(spark: SparkSession, paths: Mapping[str, str], headers: Mapping[str, list[str]], sep: str, encoding: str
                ) -> dict[str, Dataset | str]:
    width = len(next(iter(headers.values())))
    places = [f"c{i}" for i in range(width)]
    layout = T.StructType([T.StructField(n, T.StringType()) for n in [*places, _WHOLE_ROW]])
    raw = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')
           .option("columnNameOfCorruptRecord", _WHOLE_ROW).option("columnPruning", False).schema(layout).csv(list(paths.values())))
    copy = work_path(spark, "csv")
    raw.select("*", _file_name().alias("_file")).write.partitionBy("_file").parquet(copy)
    rows = spark.read.schema(T.StructType([*layout.fields, T.StructField("_file", T.StringType())])).parquet(copy)
    nulled = rows.select("_file", *[F.when(~F.col(n).isin(*C.NA_TOKENS), F.col(n)).alias(n) for n in places])
    fields = F.regexp_count(F.regexp_replace(_WHOLE_ROW, r'"([^"]|"")*"', ""), F.lit(re.escape(sep))) + 1
    surplus = F.count_if(F.col(_WHOLE_ROW).isNotNull() & (fields > width))
    found = [rows.groupBy("_file").agg(surplus.alias("surplus")).select("_file", F.lit(-1).alias("at"), F.array(F.col("surplus").cast("string")).alias("tags"))]
    for at in range(0, width, CHUNK):
        checks = [_type_tag(F.col(n)) for n in places[at:at + CHUNK]]
        found.append(nulled.groupBy("_file").agg(F.array(*checks).alias("tags")).select("_file", F.lit(at).alias("at"), "tags"))
    tags: dict[str, dict[int, str]] = {n: {} for n in paths}
    for row in reduce(DataFrame.unionAll, found).collect():  # a few short texts per file
        tags[row["_file"]].update({row["at"] + i: t for i, t in enumerate(row["tags"])})
    out: dict[str, Dataset | str] = {}
    for name, path in paths.items():
        own, bad = tags[name], int(tags[name].get(-1, 0))
        if bad:
            out[name] = f"{bad} rows have more than {width} fields"
            continue
        df = nulled.where(F.col("_file") == name).select(*[_typed(F.col(p), own.get(i, "double")).alias(n) for i, (p, n) in enumerate(zip(places, headers[name]))])
        meta = file_meta(path)
        out[name] = Dataset(meta["dataset_name"], df, meta)
    return out


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts with header; null is an empty cell."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"') \
        .option("emptyValue", "").csv(path)
