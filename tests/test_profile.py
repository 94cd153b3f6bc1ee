"""The profile on hand-made tables, edge cases and invariants."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lakegauge.operators import dimensions as dims
from lakegauge.operators import profile as prof
from lakegauge.operators import uniqueness as uniq
from lakegauge.plans.scan import table_scores


def rows(df):
    return {r.column_name: r for r in prof.profile(df).collect()}


def test_every_kind(spark):
    schema = ("i int, d double, b boolean, s string, t timestamp_ntz, dt date, dec decimal(9,2), a array<int>, "
              "m map<string,int>, bin binary")
    df = spark.createDataFrame([
        (1, 1.0, True, "aé", datetime(2024, 1, 1), date(2024, 1, 1), Decimal("1.50"), [1, 2], {"k": 1}, bytearray(b"x")),
        (1, float("nan"), False, "  ", None, date(2023, 1, 1), Decimal("2.00"), [1, 2], {"k": 1}, bytearray(b"x")),
        (None, 0.0, None, None, datetime(2024, 1, 1), None, None, None, None, None),
        (3, -0.0, True, "x" * 70, datetime(2025, 1, 1), date(2024, 1, 1), Decimal("1.50"), [], {"k": 2}, None),
    ], schema)
    p = rows(df)
    assert [p[c].kind for c in ("i", "d", "b", "s", "t", "dt", "dec", "a", "m", "bin")] == [
        "numeric", "numeric", "numeric", "text", "temporal", "temporal", "numeric", "nested", "nested", "text"]
    assert (p["i"].nulls, p["i"].distinct_cnt, p["i"].min_value, p["i"].max_value) == (1, 2, "1", "3")
    # NaN is missing; both zeros are one value
    assert (p["d"].nulls, p["d"].distinct_cnt, p["d"].max_value) == (1, 2, "1.0")
    assert (p["b"].distinct_cnt, p["b"].min_value, p["b"].max_value) == (2, "False", "True")
    assert (p["s"].distinct_cnt, p["s"].max_len, p["s"].non_blank) == (3, 70, 2)
    assert p["s"].avg_len == pytest.approx((2 + 2 + 70) / 3)
    assert (p["t"].distinct_cnt, p["t"].min_value) == (2, "2024-01-01 00:00:00")
    assert (p["dt"].distinct_cnt, p["dec"].distinct_cnt, p["a"].distinct_cnt, p["m"].distinct_cnt, p["bin"].distinct_cnt) \
        == (2, 2, 2, 2, 1)


def test_empty_table(spark):
    p = prof.profile(spark.createDataFrame([], "id int, s string"))
    assert [(r.total, r.nulls, r.null_rate, r.distinct_cnt, r.distinct_ratio) for r in p.collect()] == [(0, 0, 0.0, 0, 0.0)] * 2
    r = table_scores(p).first()
    assert (r.completude, r.unicidade, r.consistencia, r.validade, r.integridade, r.freshness) == (0, 0, 0, 0, 0, 5.0)
    assert (r.score, r.classification) == (0.5, "Crítico")


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "v string, id_x string")
    p = prof.profile(df)
    r = dims.dimension_scores(p).first()
    # an empty column counts as unique and valid, yet has a distinct ratio of 0
    assert (r.completude, r.unicidade, r.validade, r.integridade, r.freshness) == (5.0, 10.0, 10.0, 10.0, 5.0)
    c = {x.column_name: x for x in dims.column_dimension_scores(p).collect()}
    assert (c["v"].validade, c["v"].unicidade, c["v"].integridade) == (0.0, 0.0, 0.0)


def test_many_columns_use_several_chunks(spark):
    df = spark.range(50).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(37)])
    p = rows(df)
    assert [p[f"c{i}"].distinct_cnt for i in range(37)] == list(range(1, 38))
    assert [p[f"c{i}"].ordinal for i in range(37)] == list(range(37))


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "c`d", "e f"])
    assert set(rows(df)) == {"a.b", "c`d", "e f"}


def test_long_values_are_told_apart(spark):
    a, b = "x" * 5000 + "1", "x" * 5000 + "2"
    assert rows(spark.createDataFrame([(a,), (b,), (a,)], "v string"))["v"].distinct_cnt == 2


def test_profile_does_not_depend_on_partitioning(spark):
    df = spark.range(0, 2000, 1, 1).select(
        (F.col("id") % 97).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("s"))
    one, many = (sorted(map(tuple, prof.profile(d).collect())) for d in (df, df.repartition(13)))
    assert one == many


def test_approximate_is_near(spark):
    df = spark.range(20000).select("id", (F.col("id") % 100).alias("k"))
    got = {r.column_name: r.distinct_cnt for r in prof.profile(df, distinct="approx").collect()}
    assert abs(got["id"] - 20000) < 2000 and abs(got["k"] - 100) < 10


def test_no_cartesian_and_no_python(spark):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s"))
    plan = prof.profile(df)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan


def test_hot_value_is_combined_before_the_shuffle(spark):
    df = spark.range(0, 100000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
        F.col("id").cast("string")).alias("v"))
    assert rows(df)["v"].distinct_cnt == 33335
    plan = prof.distinct_counts(prof.cell_keys(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") >= 4  # partial and final, per value and per column


def test_row_identity_forms(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a|", "b"), ("a", "|b"), ("a", None)], "x string, y string")
    strict, text = uniq.row_uniqueness(df).first(), uniq.row_uniqueness(df, as_joined_text=True).first()
    assert (strict.total, strict.distinct_rows) == (5, 4)
    assert (text.total, text.distinct_rows) == (5, 2)


def test_row_uniqueness_of_nothing(spark):
    r = uniq.row_uniqueness(spark.createDataFrame([], "x int")).first()
    assert (r.total, r.distinct_rows, r.score) == (0, 0, 0.0)


def test_key_uniqueness(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "k int, s string")
    assert uniq.key_uniqueness(df, ["k"]).first().distinct_keys == 2
    assert uniq.key_uniqueness(df, ["k", "s"]).first().distinct_keys == 1
    assert uniq.key_uniqueness(df, []).first().score == 10.0
    assert uniq.key_uniqueness(df.where("k > 9"), ["k"]).first().score == 10.0


def test_required_completeness_edges(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x")], "a double, b string")
    assert uniq.required_completeness(df, ["a", "b"]).first().score == 5.0
    assert uniq.required_completeness(df, []).first().score == 10.0
    assert uniq.required_completeness(df.where("b = 'zz'"), ["a"]).first().score == 10.0


cell = st.one_of(st.none(), st.text(max_size=80), st.sampled_from(["", " ", "a", "é"]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(cell, st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.floats())), max_size=30))
def test_against_plain_python(spark, data):
    p = rows(spark.createDataFrame(data, "s string, i long, d double"))
    texts = [r[0] for r in data if r[0] is not None]
    assert p["s"].distinct_cnt == len(set(texts))
    assert p["s"].nulls == len(data) - len(texts)
    assert p["s"].max_len == (max(map(len, texts)) if texts else None)
    ints = [r[1] for r in data if r[1] is not None]
    assert (p["i"].distinct_cnt, p["i"].min_value) == (len(set(ints)), str(min(ints)) if ints else None)
    floats = [r[2] for r in data if r[2] is not None and r[2] == r[2]]
    assert (p["d"].distinct_cnt, p["d"].nulls) == (len(set(floats)), len(data) - len(floats))
    r = table_scores(prof.profile(spark.createDataFrame(data, "s string, i long, d double"))).first()
    assert all(0 <= r[d] <= 10 for d in ("completude", "unicidade", "validade", "integridade", "freshness", "score"))


def test_json_kinds(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ('{"a": 1}',), ("[1]",), ("abc",), ("true",), (None,)], "v string")
    p = prof.profile(df, distinct="none", lexical=True).first()
    assert p.type_count == 6
    assert dims.dimension_scores(prof.profile(df, distinct="none", lexical=True), only=("consistencia",)).first()[
        "consistencia"] == 0.0
