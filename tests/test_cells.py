"""Cell expressions on hand-made values."""

import math
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F, types as T

from lakegauge.functions import cells, scoring
from lakegauge.sources.prepare import sanitize_columns, sanitize_name, split_pasted_csv, unpasted


def values(spark, rows, type_, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {type_}")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_ptbr_numbers(spark):
    texts = ["12,5%", "1.234,56", "1.5", " 7 ", "  ", "abc", "1d", None, "1_000", "-3,5", "nan", "1,2,3", "5e2", "%", "inf"]
    got = values(spark, texts, "string", cells.parse_ptbr_number)
    assert got == [0.125, 1234.56, 15.0, 7.0, None, None, None, None, 1000.0, -3.5, None, None, 500.0, None, math.inf]
    tested = values(spark, ["nan", "abc", "1.5", "7%"], "string", cells.is_ptbr_number)
    assert tested == [True, False, True, True]


def test_datetimes(spark):
    texts = ["2024-01-05", "2024-1-5 1:02:03", "05/01/2024", "13/01/2024", "12/31/2024", "12:30", "2024", "24-01-05",
             " 2024-01-05T10:00:00 ", "2024-02-30", "2024-01-05 10:00:00.25", "n/a", None, "31-12-2024", "2024/12/31"]
    first = values(spark, texts, "string", lambda c: cells.parse_datetime(c))
    assert first == [
        datetime(2024, 1, 5), datetime(2024, 1, 5, 1, 2, 3), datetime(2024, 5, 1), datetime(2024, 1, 13),
        datetime(2024, 12, 31), None, None, None, datetime(2024, 1, 5, 10), None, datetime(2024, 1, 5, 10, 0, 0, 250000),
        None, None, datetime(2024, 12, 31), datetime(2024, 12, 31)]
    day_first = values(spark, ["05/01/2024", "12/31/2024"], "string", lambda c: cells.parse_datetime(c, day_first=True))
    assert day_first == [datetime(2024, 1, 5), datetime(2024, 12, 31)]
    assert values(spark, [1, 2], "int", lambda c: cells.parse_datetime(c, T.IntegerType())) == [None, None]


def test_datetimes_of_other_shapes(spark):
    texts = ["2024-01-05T10:00:00Z", "2024-01-05T10:00:00.123", "2024-01-05 10:30", "2024-01-05T10:30",
             "2024-01-05 10:00:00+00:00", "2024-01-05 10:00:00.123456789", "05/01/2024 10:30", "20240105", "05 Jan 2024",
             "05.01.2024", "2024-01-05T10:00:00-03:00", "31 December 2023", "2024-13-01", "20241301", "05 Foo 2024",
             "2024-01-05 25:00", "2024-01/05"]
    got = values(spark, texts, "string", lambda c: cells.parse_datetime(c))
    assert got == [
        datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 10, 0, 0, 123000), datetime(2024, 1, 5, 10, 30), datetime(2024, 1, 5, 10, 30),
        datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 10, 0, 0, 123456), datetime(2024, 5, 1, 10, 30), datetime(2024, 1, 5),
        datetime(2024, 1, 5), datetime(2024, 5, 1), datetime(2024, 1, 5, 13), datetime(2023, 12, 31), None, None, None, None, None]


def test_epoch_seconds_ignores_the_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    rows = [datetime(2024, 3, 31, 2, 30), datetime(1970, 1, 1, 0, 0, 1, 500000), datetime(1969, 12, 31, 23, 0)]
    want = [(r - datetime(1970, 1, 1)).total_seconds() for r in rows]
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert values(spark, rows, "timestamp_ntz", cells.epoch_seconds) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_strip_and_blank(spark):
    got = values(spark, ["  a \t", " ", None], "string", cells.strip)
    assert got == ["a", "", None]
    assert values(spark, [" x ", None], "string", cells.safe_str) == ["x", ""]


def test_float_text(spark):
    got = values(spark, [12345678.5, 1e7, 1.5, float("nan"), None, -25000000.0], "double",
                 lambda c: cells.as_text(c, T.DoubleType()))
    assert got == ["12345678.5", "10000000.0", "1.5", None, None, "-25000000.0"]
    numbers = [0.0005, -0.00012345, 1e-5, 1.5e-7, 1e16, -2.5e20, 1e100, 0.001, 0.25, 1e-300]
    assert values(spark, numbers, "double", lambda c: cells.as_text(c, T.DoubleType())) == [repr(n) for n in numbers]


def test_clamp_and_bands(spark):
    assert values(spark, [-1.0, 3.0, 11.0, float("nan"), None], "double", scoring.clamp10) == [0.0, 3.0, 10.0, 0.0, 0.0]
    scores = [9.0, 8.99, 7.0, 5.0, 4.99]
    assert values(spark, scores, "double", scoring.classify) == ["Excelente", "Bom", "Bom", "Atenção", "Crítico"]
    texts = ["9.5", "8", "7", "6", "x", None, "NaN"]
    assert values(spark, texts, "string", lambda c: scoring.classify(c, "report")) == [
        "Bom", "Bom", "Bom", "Atenção", "Sem classificação", "Sem classificação", "Crítico"]
    assert values(spark, [8.0, 6.0, 5.9], "double", lambda c: scoring.classify(c, "radar")) == [
        "Excelente", "Atenção", "Crítico"]


def test_exact_round_equals_python(spark):
    xs = [(10 + 10 * (q / 60000)) / 2 for q in range(0, 60000, 7)] + [2.5, 0.125, 1.005, 2.675, 5.20825]
    for digits in (2, 4):
        assert values(spark, xs, "double", lambda c: scoring.exact_round(c, digits)) == [round(x, digits) for x in xs]


def test_score_text(spark):
    got = values(spark, [9.25, 9.1, 10.0, 0.0, 0.5, None, 7.005], "double", scoring.fmt_score)
    assert got == ["9.25", "9.1", "10", "0", "0.5", "-", f"{7.005:.2f}".rstrip("0").rstrip(".")]


def test_volume_penalty_priority(spark):
    assert values(spark, [1000, 999, 100, 10, 9, 0], "long", scoring.volume_score) == [10.0, 7.0, 7.0, 4.0, 1.0, 1.0]
    got = values(spark, [0, 1, 10, 11, 30, 31], "long", lambda c: scoring.rule_penalty(c, F.lit(100)))
    assert got == [0.0, -2.0, -2.0, -4.0, -4.0, -6.0]
    assert values(spark, [5], "long", lambda c: scoring.rule_penalty(c, F.lit(0))) == [0.0]
    assert values(spark, [15, 14, 10, 6, 5], "int", scoring.priority_band) == ["Imediata", "Alta", "Alta", "Média", "Baixa"]


def test_themes(spark):
    got = values(spark, ["Valores NULOS", "Chave única duplicada", "formato", "faixa", "atualizar", "x", None], "string",
                 scoring.recommendation_theme)
    assert got == ["Completude", "Unicidade", "Validade", "Consistência", "Atualidade", "Qualidade Geral", "Qualidade Geral"]


@pytest.mark.parametrize("name,want", [
    (" Valor Total ", "valor_total"), ("2024", "s_2024"), ("ação", "ao"), ("%%", "obj"), ("a b", "a_b")])
def test_names(spark, name, want):
    assert sanitize_name(name) == want
    assert values(spark, [name], "string", cells.sanitize_expr) == [want]


def test_name_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A b", "a_b", "a b", "%"])
    assert sanitize_columns(df).columns == ["a_b", "a_b_2", "a_b_3", "col"]


def test_pasted_csv(spark):
    lines = [("U1, P1 ,T1,12,5%",), ("U2,P2",), (None,), ("a,b,c,7",), ("a,b,c,1.000",)]
    df = spark.createDataFrame(lines, "c string")
    got = {tuple(r) for r in unpasted(df).collect()}
    assert got == {("U1", "P1", "T1", "12,5%", 0.125), ("U2", "P2", None, None, None), ("a", "b", "c", "7", 7.0),
                   ("a", "b", "c", "1.000", 1000.0)}
    few = spark.createDataFrame([("a,b,c,d",), ("x",)], "c string")
    assert unpasted(few).columns == ["c"]
    assert split_pasted_csv(few, ("col1", "col2", "col3", "col4")).columns == ["col1", "col2", "col3", "col4"]


def test_number_coercion(spark):
    assert values(spark, ["1", " 2.5 ", "1e3", "x", "1d", "nan", None, "True"], "string",
                  lambda c: cells.to_number(c, T.StringType())) == [1.0, 2.5, 1000.0, None, None, None, None, None]
    assert values(spark, [True, False], "boolean", lambda c: cells.to_number(c, T.BooleanType())) == [1.0, 0.0]
    assert values(spark, [Decimal("1.50")], "decimal(9,2)", lambda c: cells.to_number(c, T.DecimalType(9, 2))) == [1.5]
    assert values(spark, [date(1970, 1, 2)], "date", lambda c: cells.to_number(c, T.DateType())) == [86400e9]
