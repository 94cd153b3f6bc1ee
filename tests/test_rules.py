"""Rules, described tables and the score chain on small tables with known answers."""

import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakegauge import constants as C
from lakegauge.operators import chain, dimensions as dims, heuristics, rules, star
from lakegauge.operators.profile import profile, profiles
from lakegauge.plans import scan
from lakegauge.sources.datasets import Dataset

CLIENTS = [(1, "a@b.c", "10"), (2, "bad", "200"), (2, None, "abc"), (None, "x@y", None)]


@pytest.fixture
def clients(spark):
    return spark.createDataFrame(CLIENTS, "id int, email string, idade string")


def results(df, spec):
    return {(r.column_name, r.rule_name): r for r in rules.evaluate_rules(df, spec).collect()}


def test_clients(clients):
    got = results(clients, {
        "id": {"not_null": True, "unique": True},
        "email": {"not_null": False, "regex": C.EMAIL_PATTERN},
        "idade": {"range": {"min": 0, "max": 120}, "foo": 1},
        "gone": {"unique": True}})
    want = {
        ("id", "not_null"): (False, 0.75, "preenchimento=0.7500"), ("id", "unique"): (False, 0.6667, "unicidade=0.6667"),
        ("email", "not_null"): (True, 0.75, "preenchimento=0.7500"),
        ("email", "regex"): (False, 0.3333, "aderência_regex=0.3333"),
        ("idade", "range"): (False, 0.3333, "aderência_range=0.3333"), ("idade", "foo"): (True, 1.0, "regra_ignorada=foo"),
        ("gone", "column_exists"): (False, 0.0, "coluna não encontrada no dataset")}
    assert {k: (r.passed, r.score, r.details) for k, r in got.items()} == want
    assert got[("idade", "range")].rule_value == '{"min": 0, "max": 120}'


def test_empty_and_all_null(spark, clients):
    spec = {"id": {"not_null": True, "unique": True}, "email": {"regex": "x", "allowed_values": ["a"]},
            "idade": {"range": {"min": 1}}}
    for df in (clients.where("id > 100"), spark.createDataFrame([(None, None, None)], clients.schema)):
        got = results(df, spec)
        assert [(got[k].passed, got[k].score) for k in (("id", "not_null"), ("id", "unique"))] == [(False, 0.0)] * 2
        for k in (("email", "regex"), ("email", "allowed_values"), ("idade", "range")):
            assert (got[k].passed, got[k].score, got[k].details) == (True, 1.0, "sem valores não nulos")


def test_regex_reads_like_python(spark):
    import re
    texts = ["abc", "xabc", "ab", "a b", "é1", "a\n", "ab\r", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for pattern in (r"a|zz", r"a\sb", r"\w\d", r"^a$", r".*b$", r"(?i)AB", r"(?P<x>a)b", r"ab\Z", "a.b"):
        want = sum(re.match(pattern, t) is None for t in texts)
        assert results(df, {"v": {"regex": pattern}})[("v", "regex")].violations == want, pattern


def test_bad_pattern_is_a_failed_row(clients):
    r = results(clients, {"email": {"regex": "(", "not_null": True}})
    assert (r[("email", "regex")].passed, r[("email", "regex")].score) == (False, 0.0)
    assert r[("email", "regex")].details.startswith("erro_regra=regex")
    assert r[("email", "not_null")].score == 0.75


def test_range_of_nan_and_text_bounds(spark):
    df = spark.createDataFrame([(float("nan"),), (5.0,), (None,), (-1.0,)], "v double")
    assert results(df, {"v": {"range": {"min": 0}}})[("v", "range")].score == 0.5
    assert results(df, {"v": {"range": {"min": "x"}}})[("v", "range")].details.startswith("erro_regra=range")


def test_allowed_values_compare_texts(spark):
    df = spark.createDataFrame([(1, True, 1.0), (2, False, 2.0)], "i int, b boolean, d double")
    got = results(df, {"i": {"allowed_values": [1]}, "b": {"allowed_values": [True]}, "d": {"allowed_values": ["1.0"]}})
    assert {r.score for r in got.values()} == {0.5}


def test_rule_lookup():
    spec = {"clientes": {"columns": {"a": 1}}, "stg.x": {"columns": {"b": 1}}, "vendas.csv": {"columns": {"c": 1}}}
    assert rules.rules_for(spec, "clientes") == {"a": 1}
    assert rules.rules_for(spec, "public.clientes") == {"a": 1}
    assert rules.rules_for(spec, "stg.x") == {"b": 1}
    assert rules.rules_for(spec, "/in/vendas.csv") == {"c": 1}
    assert rules.rules_for(spec, "other") == {}


def test_orphans_with_null_parents_and_hot_key(spark):
    child = spark.createDataFrame([(1,)] * 50 + [(9,)] * 30 + [(None,)] * 5, "k int")
    parent = spark.createDataFrame([(1,), (None,), (1,)], "p int")
    r = rules.referential_integrity(child, "k", parent, "p").first()
    assert (r.total, r.violations) == (85, 30)
    assert r.score == pytest.approx(10 * (1 - 30 / 85))
    empty = rules.referential_integrity(child.where("k > 99"), "k", parent, "p").first()
    assert (empty.total, empty.violations, empty.score) == (0, 0, 0.0)


AS_OF = datetime(2024, 5, 1, 12, 0)
_D, _H = (lambda n: AS_OF + timedelta(days=n)), (lambda n: AS_OF - timedelta(hours=n))
SEED = [
    (1001, 1, 120.50, "PAGO", -20, -18, 1), (1002, 2, 80.00, "PENDENTE", -10, -5, 2), (1003, 3, 50.00, "CANCELADO", -3, -2, 3),
    (1003, 3, 50.00, "CANCELADO", -3, -2, 3), (1004, 999, 30.00, "PAGO", -2, -1, 1), (1005, 1, -10.00, "PAGO", -1, 0, 1),
    (1006, 2, 15.00, "DESCONHECIDO", -1, 0, 1), (1007, 2, 99.99, "PAGO", -1, -2, 1), (1008, 1, 25.00, "PAGO", None, 0, 1),
    (1009, 1, 70.00, "PAGO", -60, -58, 240),
]
LATER = [
    (1010, 1, 40.00, "PAGO", -2, -1, 1), (1011, 2, 55.50, "PENDENTE", -1, None, 1), (1010, 1, 40.00, "PAGO", -2, -1, 1),
    (1012, 9999, 10.00, "PAGO", -1, 0, 1), (1013, 2, -5.00, "PAGO", -1, 0, 1), (1014, 3, 12.00, "ERRO_STATUS", -1, 0, 1),
    (1015, 1, 99.90, "PAGO", -1, -2, 1),
]


@pytest.mark.parametrize("data,want,note", [
    (SEED, (9.8, 9.0, 9.0, 8.0, 9.0, 9.583333), 9.1),
    (SEED + LATER, (9.882353, 8.823529, 8.823529, 7.647059, 8.823529, 9.583333), 8.97)])
def test_star_golden(spark, data, want, note):
    rows = [(i, c, v, s, a if a is None else _D(a), b if b is None else _D(b), _H(h)) for i, c, v, s, a, b, h in data]
    fact = spark.createDataFrame(
        rows, "id_pedido int, id_cliente int, vl_total double, status string, dt_pedido timestamp_ntz, "
              "dt_entrega timestamp_ntz, ingest_ts timestamp_ntz")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id_cliente int")
    spec = star.StarSpec(
        key="id_pedido", required=["id_pedido", "id_cliente", "vl_total", "status", "dt_pedido"],
        invalid=(F.col("vl_total") < 0) | ~F.col("status").isin("PAGO", "PENDENTE", "CANCELADO"),
        start="dt_pedido", end="dt_entrega", foreign_key="id_cliente", parent_key="id_cliente", loaded_at="ingest_ts")
    r = star.star_scan(fact, parent, spec, AS_OF).first()
    assert [round(r[d], 6) for d in C.DIMENSIONS] == list(want)
    assert (r.total, r.nota_final) == (len(data), note)


def test_chain_bug_flag_and_missing_columns(spark):
    p = profile(spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")).withColumns(
        {k: F.lit(k) for k in chain.KEYS})
    r = rules.rules_table(spark, {"object_name": {"columns": {"id": {"not_null": True}, "s": {"not_null": True}}}})
    right = {x.column_name: x for x in chain.column_scores(p, r).collect()}
    wrong = {x.column_name: x for x in chain.column_scores(p, r, zero_null_bug=True).collect()}
    assert (right["id"].score_base, wrong["id"].score_base) == (10.0, 3.0)
    assert (right["s"].violations, right["s"].score_rules, right["s"].score_final) == (1, -6.0, 0.5)
    tables = chain.table_scores(p)
    none = chain.column_scores(p, r).where("false")
    d = chain.dimension_table(tables, none, chain.table_scores_with_rules(tables, none).where("false")).first()
    assert (d.dim_consistencia, d.dim_validade, d.dim_integridade_ref, d.score_final) == (0.0, 0.0, 10.0, 0.0)


def test_weighted_dimensions_divide_by_all_weights(spark):
    long = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 5.0)], "k string, dimension string, score double")
    assert dims.weighted_dimensions(long, {"x": 1.0, "y": 1.0, "z": 2.0}, "k").first().score == 3.75
    weights = spark.createDataFrame([(10.0, 1.0), (4.0, 2.0)], "s double, w double")
    assert dims.weighted_mean(weights, "s", "w").first().score == 6.0
    assert dims.weighted_mean(weights.where("s > 99"), "s", "w").first().score is None


def test_heuristics_by_hand(spark):
    df = spark.createDataFrame([
        ("a@b.c", "2024-05-01", "1,5", "k-1", "x"), ("b@c.d", "2024-04-30", "2", "k 2", " "),
        ("bad", "nope", "abc", None, "y"), (None, "2024-04-29", "9%", "k4", "z")],
        "email string, dt_x string, v string, cod string, t string")
    verdict = {r.column_name: r for r in heuristics.column_verdicts(heuristics.heuristic_rates(df)).collect()}
    assert verdict["email"].validity_sum == pytest.approx(2 / 3) and verdict["email"].validity_parts == 1
    assert verdict["email"].dominant == pytest.approx(2 / 3)
    # a date column of which a quarter is unreadable: date part 0.75; its digits fall short of 80 %
    assert (verdict["dt_x"].validity_sum, verdict["dt_x"].validity_parts, verdict["dt_x"].dominant) == (0.75, 1, 0.75)
    assert (verdict["v"].validity_parts, verdict["v"].dominant) == (0, 0.75)
    assert verdict["cod"].integrity == pytest.approx(0.7 * 0.75 + 0.3 * 2 / 3)
    assert verdict["t"].dominant == 0.75
    r = heuristics.heuristic_scores(df, datetime(2024, 5, 1, 6, 0)).first()
    # every key with a digit, none of which reads as a number, adds a zero to validity
    assert (r.total_registros, r.completude, r.unicidade, r.freshness) == (4, 9.0, 10.0, 7.5)
    assert r.integridade == round(10 * (0.7 * 0.75 + 0.2), 2)
    assert r.validade == round(10 * (2 / 3 + 0.75 + 0) / 3, 2)


def test_heuristics_of_empty_table(spark):
    r = heuristics.heuristic_scores(spark.createDataFrame([], "id int"), datetime(2024, 1, 1)).first()
    assert (r.total_registros, r.completude, r.validade, r.nota_final) == (0, 0.0, 0.0, 0.0)


def test_a_scan_reads_each_column_for_profile_and_rules_together(spark, tmp_path):
    """Rules ride on the profile's readings: as many scans with rules as without, each column in one of either kind."""
    path = str(tmp_path / "t")
    spark.range(500).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(10)]).write.parquet(path)
    found = [Dataset("t", spark.read.parquet(path), {"dataset_name": "t"})]
    wanted = {"t": {"columns": {f"c{i}": {"not_null": True, "unique": True, "range": {"min": 0, "max": 5}} for i in range(10)}
                   | {"gone": {"unique": True}}}}
    part, tested = scan.measured(found, wanted, "r", datetime(2024, 3, 1))
    alone = scan.rule_results(found, wanted, "r", datetime(2024, 3, 1))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(tested) == rows(alone) and len(rows(tested)) == 31
    assert rows(part) == rows(scan.scan_profile(found, "r", datetime(2024, 3, 1)))
    df = found[0].df
    _, tests = rules.compiled(df, wanted["t"]["columns"])
    both = profiles([({}, df)], extras=[rules.aggregates(tests)], none=rules.no_test())
    scans = [line for line in both._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]
    read = Counter(c for line in scans for c in re.findall(r"c\d(?=#)", line.split("Batched")[0]))
    assert read == Counter({f"c{i}": 2 for i in range(10)}), "once for counts and rules, once for distinct values"
