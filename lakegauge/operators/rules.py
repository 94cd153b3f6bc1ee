"""Declarative data tests.

Rules come as {column: {rule: value}}. All counting rules of a dataset become
expressions of one aggregate; the distinct counts that `unique` needs come from
the skew-proof distinct pass of the profile. A rule result is one row:
column_name, rule_name, rule_value, passed, score, details (plus the integer
counts checked and violations it is derived from).
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import cells, scoring
from lakegauge.operators.profile import cell_keys, chunked, distinct_counts, quoted

RESULT = ("column_name string, rule_name string, rule_value string, checked bigint, violations bigint, "
          "passed boolean, score double, details string")


@dataclass(frozen=True)
class _Test:
    """One compiled rule: how many cells it looks at and how many are wrong."""
    column: str
    rule: str
    value: str
    checked: Column
    violations: Column
    enforced: bool = True
    empty_passes: bool = True


def value_text(value: Any) -> str:
    if isinstance(value, (dict, list)):
        return json.dumps(value, ensure_ascii=False)
    return "" if value is None else str(value).strip()


def rules_for(rules: Mapping[str, Any], dataset: str) -> Mapping[str, Mapping[str, Any]]:
    """Column rules of a dataset: by full name, last path part, then bare table name."""
    for key in (dataset, dataset.rsplit("/", 1)[-1], dataset.rsplit(".", 1)[-1]):
        if rules.get(key):
            return rules[key].get("columns") or {}
    return {}


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern cannot be used, or None; evaluated on a constant, so no job runs."""
    try:
        spark.sql("SELECT '' RLIKE :p AS ok", args={"p": cells.text_regex(pattern)}).collect()
    except PySparkException as error:
        return str(error).splitlines()[0]
    return None


def violates(c: Column, data_type: T.DataType, rule: str, value: Any) -> Column:
    """True for a present cell that breaks a regex, range or allowed_values rule."""
    if rule == "regex":
        return ~cells.as_text(c, data_type).rlike(cells.text_regex(str(value)))
    if rule == "allowed_values":
        wanted = [str(v) for v in value or []]
        return ~cells.as_text(c, data_type).isin(wanted) if wanted else F.lit(True)
    number = cells.to_number(c, data_type)
    bounds = value if isinstance(value, Mapping) else {}
    inside = number.isNotNull()
    if bounds.get("min") is not None:
        inside = inside & (number >= F.lit(float(bounds["min"])))
    if bounds.get("max") is not None:
        inside = inside & (number <= F.lit(float(bounds["max"])))
    return ~inside


def _compile(field: T.StructField, rule: str, value: Any) -> _Test:
    c, dt = quoted(field.name), field.dataType
    present = cells.present(c, dt)
    total, there = F.count(F.lit(1)), F.count(present)
    text = value_text(value)
    if rule == "not_null":
        return _Test(field.name, rule, text, total, total - there, bool(value), empty_passes=False)
    if rule == "unique":
        # the surplus is filled in from the distinct pass
        return _Test(field.name, rule, text, there, F.lit(None), bool(value), empty_passes=False)
    bad = F.count_if(present.isNotNull() & F.coalesce(violates(c, dt, rule, value), F.lit(True)))
    return _Test(field.name, rule, text, there, bad)


def compiled(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> tuple[list[tuple], list[tuple[int, _Test]]]:
    """Result rows that need no data (absent columns, unknown and broken rules), and (ordinal, test) of the others by column."""
    fields = {f.name: (i, f) for i, f in enumerate(df.schema.fields)}
    fixed: list[tuple] = []
    tests: list[tuple[int, _Test]] = []
    for column, column_rules in rules.items():
        if column not in fields:
            fixed.append((column, "column_exists", "required", 0, 0, False, 0.0, C.COLUMN_ABSENT))
            continue
        ordinal, field = fields[column]
        for rule, value in (column_rules or {}).items():
            if rule not in C.RULE_DETAILS:
                fixed.append((column, rule, value_text(value), 0, 0, True, 1.0, C.RULE_IGNORED % rule))
                continue
            try:
                problem = pattern_error(df.sparkSession, str(value)) if rule == "regex" else None
                test = None if problem else _compile(field, rule, value)
            except (TypeError, ValueError) as error:
                problem, test = str(error), None
            if problem:
                fixed.append((column, rule, value_text(value), 0, 0, False, 0.0, C.RULE_ERROR % (rule, problem)))
            else:
                tests.append((ordinal, test))
    return fixed, sorted(tests, key=lambda t: t[0])


def aggregates(tests: list[tuple[int, _Test]]) -> dict[int, list[Column]]:
    """Ordinal -> one struct per test of that column, to be taken in one reading with whatever else is asked of it."""
    out: dict[int, list[Column]] = {}
    for o, t in tests:
        out.setdefault(o, []).append(F.struct(
            F.lit(t.column).alias("column_name"), F.lit(t.rule).alias("rule_name"), F.lit(t.value).alias("rule_value"),
            F.lit(t.enforced).alias("enforced"), F.lit(t.empty_passes).alias("empty_passes"),
            t.checked.cast("bigint").alias("checked"), t.violations.cast("bigint").alias("violations")))
    return out


def no_test() -> Column:
    """A null in place of a test."""
    return F.lit(None).cast("struct<column_name: string, rule_name: string, rule_value: string, enforced: boolean, "
                            "empty_passes: boolean, checked: bigint, violations: bigint>")


def evaluate_rules(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Result rows of every rule of one dataset. All tests of a column are taken in one reading of it."""
    fixed, tests = compiled(df, rules)
    rows = fixed_rows(df.sparkSession, fixed)
    if not tests:
        return rows
    found = list(aggregates(tests).items())
    parts = []
    for run in chunked([len(structs) for _, structs in found]):
        structs = [F.struct(F.lit(o).alias("ordinal"), s.alias("r")) for o, own in found[run.start:run.stop] for s in own]
        parts.append(df.agg(F.array(*structs).alias("x")).select(F.inline("x")).select("ordinal", "r.*"))
    counted = reduce(DataFrame.unionAll, parts)
    unique = [o for o, t in tests if t.rule == "unique"]
    counts = distinct_counts(cell_keys(df, unique)) if unique else df.sparkSession.createDataFrame([], "ordinal int, distinct_cnt bigint")
    judged_rows = judged(counted.join(F.broadcast(counts), "ordinal", "left"))  # one row per column
    return rows.unionAll(judged_rows) if fixed else judged_rows


def fixed_rows(spark: SparkSession, fixed: list[tuple]) -> DataFrame:
    return spark.createDataFrame(fixed, RESULT)


def judged(counted: DataFrame, *labels: str) -> DataFrame:
    """Result rows from the counts of tests; `unique` takes its surplus from the distinct values beside them."""
    counted = counted.withColumn("violations", F.coalesce("violations", F.col("checked") - F.coalesce("distinct_cnt", F.lit(0))))
    checked, bad = F.col("checked"), F.col("violations")
    nothing = (checked == 0) & F.col("empty_passes")
    score = F.when(nothing, 1.0).otherwise(cells.ratio(checked - bad, checked))
    passed = nothing | ~F.col("enforced") | ((checked > 0) & (bad == 0))
    shown = scoring.exact_round(score, 4)
    details = F.when(nothing, C.NO_VALUES)
    for rule, template in C.RULE_DETAILS.items():
        details = details.when(F.col("rule_name") == rule, F.format_string(template, shown))
    return counted.select(*labels, "column_name", "rule_name", "rule_value", "checked", "violations",
                          passed.alias("passed"), shown.alias("score"), details.alias("details"))


def results_of(profile: DataFrame, *labels: str) -> DataFrame:
    """Result rows from a profile whose `extra` holds the tests of each column and which has exact distinct counts."""
    tests = profile.select(*labels, "distinct_cnt", F.explode("extra").alias("r")).where(F.col("r").isNotNull())
    return judged(tests.select(*labels, "distinct_cnt", "r.*"), *labels)


def violation_counts(df: DataFrame, rules: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Exact violations per column over all its enforced rules."""
    results = evaluate_rules(df, rules)
    switched_off = F.col("rule_name").isin("not_null", "unique") & (F.lower("rule_value") == "false")
    return (results.where(F.col("rule_name").isin(list(C.RULE_DETAILS)) & ~switched_off)
            .groupBy("column_name").agg(F.sum("violations").alias("violations"), F.max("checked").alias("checked")))


def rules_table(spark: SparkSession, rules: Mapping[str, Any]) -> DataFrame:
    """The rule set as rows, one per dataset and column, in the layout of the column scores."""
    rows = []
    for dataset, spec in rules.items():
        for column, r in (spec.get("columns") or {}).items():
            r = r or {}
            bounds, allowed = r.get("range") or {}, r.get("allowed_values")
            rows.append((
                dataset, column,
                bool(r["not_null"]) if "not_null" in r else None,
                bool(r["unique"]) if "unique" in r else None,
                r.get("regex"),
                None if bounds.get("min") is None else float(bounds["min"]),
                None if bounds.get("max") is None else float(bounds["max"]),
                ",".join(map(str, allowed)) if isinstance(allowed, list) else None,
            ))
    return spark.createDataFrame(
        rows, "object_name string, column_name string, rule_not_null boolean, rule_unique boolean, "
              "rule_regex string, rule_range_min double, rule_range_max double, rule_allowed_vals string")


def estimate_violations(p: DataFrame, rules: DataFrame, dataset: str = "object_name") -> DataFrame:
    """Violations guessed from profile numbers alone: only not_null and unique count."""
    joined = p.join(rules.withColumnRenamed("object_name", dataset), [dataset, "column_name"], "left")
    total = F.coalesce("total", F.lit(0))
    null_rate = F.coalesce("null_rate", F.lit(0.0))
    missing = F.rint(total * null_rate).cast("bigint")
    there = F.rint(total * (1 - null_rate)).cast("bigint")
    surplus = F.greatest(F.lit(0).cast("bigint"), there - F.rint(F.col("distinct_ratio") * there).cast("bigint"))
    counted = (F.when(F.col("rule_not_null"), missing).otherwise(0)
               + F.when(F.col("rule_unique") & F.col("distinct_ratio").isNotNull(), surplus).otherwise(0))
    return joined.withColumn("violations", counted.cast("bigint"))


# --- tests over several columns or tables --------------------------------------

def violation_score(violations: Column, total: Column) -> Column:
    """10 x (1 - violations / all rows); 0 for an empty table."""
    return F.when(total > 0, scoring.score10(1 - violations / total)).otherwise(0.0)


def predicate_validity(df: DataFrame, bad: Column) -> DataFrame:
    """Rows for which `bad` holds; an unknown comparison is no violation."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(bad, F.lit(False))).alias("violations")) \
        .withColumn("score", violation_score(F.col("violations"), F.col("total")))


def cross_column_order(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows whose start lies after their end, both being present."""
    return predicate_validity(df, quoted(start) > quoted(end))


def orphan_count(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row (violations): rows with a key that the parent table lacks.

    Keys are counted first, so a key held by a third of all rows reaches the
    join as one row and no task sees a hot group; Spark picks the join by size.
    """
    counted = df.where(quoted(key).isNotNull()).groupBy(quoted(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(quoted(parent_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return counted.join(known, "_k", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("violations"))


def referential_integrity(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("violations", F.lit(None).cast("bigint"))
    orphans = orphan_count(df, key, parent, parent_key).withColumn("total", F.lit(None).cast("bigint"))
    return total.unionByName(orphans).agg(F.max("total").alias("total"), F.max("violations").alias("violations")) \
        .withColumn("score", violation_score(F.col("violations"), F.col("total")))
