"""Rules, cross-table tests, described and heuristic table scores."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lakegauge import constants as C
from lakegauge.operators import heuristics, profile as prof, rules, star, uniqueness as uniq
from lakegauge.operators.chain import column_scores
from workload.profiles import BLANKS, DATASETS, float_of, parse_dt, profile_sql, profiles, ptbr_plain, strip
from workload.registry import load, query, rounded
from workload.tables import STAR_NOTE, clamp, cte, order_texts, orders_dirty

EMAIL_SQL = r"regexp_matches({x}, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"
_RULE_COLUMNS = "column_name, rule_name, passed, round(score, 4) AS score"
_RESULT = ["column_name", "rule_name", "rule_value", "checked", "violations", "passed", "score", "details"]


def _result_sql(column: str, rule: str, value: str, checked: str, bad: str, template: str, enforced: bool = True,
                empty_passes: bool = True, source: str = "orders_dirty") -> str:
    return f"""SELECT '{column}' AS column_name, '{rule}' AS rule_name, '{value}' AS rule_value,
      ({checked})::BIGINT AS checked, ({bad})::BIGINT AS violations,
      {'TRUE' if not enforced else f'({bad}) = 0'} AS passed,
      round((({checked}) - ({bad})) / ({checked}), 4)::DOUBLE AS score,
      printf('{template}', (({checked}) - ({bad})) / ({checked})) AS details FROM {source}"""


def _not_null(c, enforced=True):
    return _result_sql(c, "not_null", str(enforced), "count(*)", f"count(*) - count({c})", "preenchimento=%.4f",
                       enforced, False)


def _unique(c, enforced=True):
    return _result_sql(c, "unique", str(enforced), f"count({c})", f"count({c}) - count(DISTINCT {c})",
                       "unicidade=%.4f", enforced, False)


def _regex(c, pattern):
    return _result_sql(c, "regex", pattern, f"count({c})",
                       f"count(*) FILTER (WHERE NOT regexp_matches({c}, '^(?:{pattern})'))", "aderência_regex=%.4f")


def _range(c, number, value, low, high):
    ok = " AND ".join([f"{number} IS NOT NULL"] + ([f"{number} >= {low}"] if low is not None else [])
                      + ([f"{number} <= {high}"] if high is not None else []))
    return _result_sql(c, "range", value, f"count({c})",
                       f"count(*) FILTER (WHERE {c} IS NOT NULL AND NOT coalesce({ok}, FALSE))", "aderência_range=%.4f")


def _allowed(c, values, text):
    listed = ", ".join(f"'{v}'" for v in values)
    return _result_sql(c, "allowed_values", text, f"count({c})",
                       f"count(*) FILTER (WHERE {c}::VARCHAR NOT IN ({listed}))", "aderência_allowed=%.4f")


def _evaluated(spark, sf_dir, spec):
    return rules.evaluate_rules(orders_dirty(spark, sf_dir), spec).select(*_RESULT)


def _sql(*parts):
    return cte(" UNION ALL ".join(parts), "orders_dirty")


@query("rule_not_null", _sql(_not_null("status"), _not_null("customer_id"), _not_null("email", False)))
def rule_not_null(spark, sf_dir):
    return _evaluated(spark, sf_dir, {"status": {"not_null": True}, "customer_id": {"not_null": True},
                                      "email": {"not_null": False}})


@query("rule_unique", _sql(_unique("o_orderkey"), _unique("customer_id"), _unique("email", False)))
def rule_unique(spark, sf_dir):
    return _evaluated(spark, sf_dir, {"o_orderkey": {"unique": True}, "customer_id": {"unique": True},
                                      "email": {"unique": False}})


@query("rule_regex", _sql(_regex("email", C.EMAIL_PATTERN), _regex("status", "F|O"), _regex("valor_txt", r"\d+,5%?$")))
def rule_regex(spark, sf_dir):
    return _evaluated(spark, sf_dir, {"email": {"regex": C.EMAIL_PATTERN}, "status": {"regex": "F|O"},
                                      "valor_txt": {"regex": r"\d+,5%?$"}})


@query("rule_range", _sql(
    _range("vl_total", "vl_total", '{"min": 0}', 0, None),
    _range("customer_id", "customer_id", '{"min": 0, "max": 1000000}', 0, 1000000),
    _range("valor_txt", float_of("valor_txt"), '{"max": 50}', None, 50)))
def rule_range(spark, sf_dir):
    return _evaluated(spark, sf_dir, {"vl_total": {"range": {"min": 0}},
                                      "customer_id": {"range": {"min": 0, "max": 1000000}},
                                      "valor_txt": {"range": {"max": 50}}})


@query("rule_range_text", cte(
    f"""SELECT count(number_mix) AS checked, count(*) FILTER (WHERE number_mix IS NOT NULL AND NOT
      coalesce({float_of(strip('number_mix'))} BETWEEN 0 AND 5000, FALSE)) AS violations FROM order_texts""", "order_texts"))
def rule_range_text(spark, sf_dir):
    return rules.evaluate_rules(order_texts(spark, sf_dir), {"number_mix": {"range": {"min": 0, "max": 5000}}}).select(
        "checked", "violations")


@query("rule_allowed_values", _sql(
    _allowed("status", ["F", "O", "P"], '["F", "O", "P"]'), _allowed("email", ["x"], '["x"]')))
def rule_allowed_values(spark, sf_dir):
    return _evaluated(spark, sf_dir, {"status": {"allowed_values": ["F", "O", "P"]}, "email": {"allowed_values": ["x"]}})


SUITE = {
    "orders_dirty": {"columns": {
        "o_orderkey": {"not_null": True, "unique": True},
        "status": {"not_null": True, "allowed_values": ["F", "O", "P"]},
        "email": {"not_null": False, "regex": C.EMAIL_PATTERN},
        "vl_total": {"range": {"min": 0, "max": 1000000}, "fresher": "yes"},
        "customer_id": {"not_null": True, "unique": True},
        "absent": {"not_null": True},
    }},
}
_FIXED = ("SELECT 'absent' AS column_name, 'column_exists' AS rule_name, 'required' AS rule_value, 0::BIGINT AS checked, "
          "0::BIGINT AS violations, FALSE AS passed, 0.0::DOUBLE AS score, 'coluna não encontrada no dataset' AS details",
          "SELECT 'vl_total', 'fresher', 'yes', 0::BIGINT, 0::BIGINT, TRUE, 1.0::DOUBLE, 'regra_ignorada=fresher'")


@query("rule_suite", _sql(
    *_FIXED, _not_null("o_orderkey"), _unique("o_orderkey"), _not_null("status"),
    _allowed("status", ["F", "O", "P"], '["F", "O", "P"]'), _not_null("email", False), _regex("email", C.EMAIL_PATTERN),
    _range("vl_total", "vl_total", '{"min": 0, "max": 1000000}', 0, 1000000), _not_null("customer_id"),
    _unique("customer_id")))
def rule_suite(spark, sf_dir):
    return _evaluated(spark, sf_dir, rules.rules_for(SUITE, "stg.orders_dirty"))


@query("rule_violation_counts", cte(f"""
    SELECT 'o_orderkey' AS column_name, (count(*) - count(DISTINCT o_orderkey))::BIGINT AS violations,
      count(*)::BIGINT AS checked FROM orders_dirty
    UNION ALL SELECT 'status', (count(*) FILTER (WHERE status IS NULL OR status NOT IN ('F','O','P')))::BIGINT,
      count(*) FROM orders_dirty
    UNION ALL SELECT 'email', count(*) FILTER (WHERE NOT {EMAIL_SQL.format(x='email')}), count(email) FROM orders_dirty
    UNION ALL SELECT 'vl_total', count(*) FILTER (WHERE vl_total NOT BETWEEN 0 AND 1000000), count(vl_total)
      FROM orders_dirty
    UNION ALL SELECT 'customer_id', count(*) - count(DISTINCT customer_id), count(*) FROM orders_dirty""",
    "orders_dirty"))
def rule_violation_counts(spark, sf_dir):
    return rules.violation_counts(orders_dirty(spark, sf_dir), SUITE["orders_dirty"]["columns"])


ESTIMATE_SQL = """
    SELECT *, (CASE WHEN column_name IN ('o_orderkey', 'status', 'customer_id')
                    THEN round_even(total * null_rate, 0) ELSE 0 END
      + CASE WHEN column_name IN ('o_orderkey', 'customer_id')
             THEN greatest(0, round_even(total * (1 - null_rate), 0)
                  - round_even(distinct_ratio * round_even(total * (1 - null_rate), 0), 0)) ELSE 0 END)::BIGINT AS violations
    FROM p"""


@query("rule_violations_estimated", profile_sql(
    f"SELECT column_name, total, violations FROM ({ESTIMATE_SQL})", ("orders_dirty",)))
def rule_violations_estimated(spark, sf_dir):
    p = profiles(spark, sf_dir, ("orders_dirty",)).withColumnRenamed("dataset", "object_name")
    return rules.estimate_violations(p, rules.rules_table(spark, SUITE)).select("column_name", "total", "violations")


# --- several columns or tables ------------------------------------------------------------

def _score_sql(bad: str, source: str) -> str:
    return (f"SELECT count(*) AS total, ({bad})::BIGINT AS violations, "
            f"round({clamp(f'10 * (1 - ({bad}) / count(*))')}, 6) AS score FROM {source}")


@query("predicate_validity", cte(
    _score_sql("count(*) FILTER (WHERE vl_total < 0 OR status NOT IN ('F','O','P'))", "orders_dirty"), "orders_dirty"))
def predicate_validity(spark, sf_dir):
    bad = (F.col("vl_total") < 0) | ~F.col("status").isin("F", "O", "P")
    return rounded(rules.predicate_validity(orders_dirty(spark, sf_dir), bad))


@query("cross_column_order", cte(
    _score_sql("count(*) FILTER (WHERE dt_pedido > dt_entrega)", "orders_dirty"), "orders_dirty"))
def cross_column_order(spark, sf_dir):
    return rounded(rules.cross_column_order(orders_dirty(spark, sf_dir), "dt_pedido", "dt_entrega"))


@query("cross_table_order", """
    SELECT count(*) AS total, count(*) FILTER (WHERE o_orderdate > l_shipdate) AS violations,
      round(10 * (1 - count(*) FILTER (WHERE o_orderdate > l_shipdate) / count(*)), 6) AS score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def cross_table_order(spark, sf_dir):
    """The same test when the two dates live in different tables.

    Line items are counted per order and date first, so that an order with very many
    lines reaches the join as one row per date.
    """
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    late = F.col("o_orderdate") > F.col("l_shipdate")
    return rounded(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("violations"),
    ).withColumn("score", rules.violation_score(F.col("violations"), F.col("total"))))


@query("referential_integrity", cte(
    "SELECT 'documents' AS dataset, * FROM (" + _score_sql(
        "count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NULL)",
        "documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
    + ") UNION ALL SELECT 'orders_dirty', * FROM (" + _score_sql(
        "count(*) FILTER (WHERE customer_id IS NOT NULL AND c_custkey IS NULL)",
        "orders_dirty LEFT JOIN customer ON customer_id = c_custkey") + ")", "orders_dirty"))
def referential_integrity(spark, sf_dir):
    docs = rules.referential_integrity(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "labels"), "doc_id")
    orders = rules.referential_integrity(orders_dirty(spark, sf_dir), "customer_id",
                                         load(spark, sf_dir, "customer"), "c_custkey")
    return rounded(docs.withColumn("dataset", F.lit("documents")).unionByName(
        orders.withColumn("dataset", F.lit("orders_dirty"))))


# --- described fact table -------------------------------------------------------------------

AS_OF = datetime(2024, 2, 1, 6, 30)
ORDERS_AS_OF = datetime(2001, 12, 10, 12, 0)
_ORDERS_HOURS = "(epoch(TIMESTAMP '2001-12-10 12:00:00') - epoch(max({c}))) / 3600"
_STAR = ("customer_id", "vl_total", "status", "dt_pedido", "email")
_STAR_NULLS = " + ".join(f"(count(*) - count({c}))" for c in _STAR)
_STAR_SQL = {
    "facts": f"""SELECT count(*) AS total,
        {clamp(f'10 * (1 - ({_STAR_NULLS}) / {len(_STAR)}.0 / count(*))')} AS completude,
        {clamp('10 * count(DISTINCT o_orderkey) / count(*)')} AS unicidade,
        {clamp('10 * (1 - count(*) FILTER (WHERE dt_pedido > dt_entrega) / count(*))')} AS consistencia,
        {clamp("10 * (1 - count(*) FILTER (WHERE vl_total < 0 OR status NOT IN ('F','O','P')) / count(*))")} AS validade,
        {clamp('10 * (1 - count(*) FILTER (WHERE customer_id IS NOT NULL AND c_custkey IS NULL) / count(*))')} AS integridade,
        {clamp('10 * (1 - ' + _ORDERS_HOURS.format(c='o_orderdate') + ' / 8760)')} AS freshness
      FROM orders_dirty LEFT JOIN customer ON customer_id = c_custkey""",
}
_DIMS6 = ", ".join(f"round({d}, 6) AS {d}" for d in C.DIMENSIONS)


def _star(spark, sf_dir):
    spec = star.StarSpec(
        key="o_orderkey", required=_STAR, invalid=(F.col("vl_total") < 0) | ~F.col("status").isin("F", "O", "P"),
        start="dt_pedido", end="dt_entrega", foreign_key="customer_id", parent_key="c_custkey",
        loaded_at="o_orderdate", sla_hours=8760.0)
    return star.star_scan(orders_dirty(spark, sf_dir), load(spark, sf_dir, "customer"), spec, ORDERS_AS_OF)


@query("star_dimension_scores", cte(f"SELECT total, {_DIMS6} FROM facts", "orders_dirty", **_STAR_SQL))
def star_dimension_scores(spark, sf_dir):
    return rounded(_star(spark, sf_dir).drop("nota_final"))


@query("star_final_score", cte(f"SELECT total, round({STAR_NOTE}, 2) AS nota_final FROM facts", "orders_dirty", **_STAR_SQL))
def star_final_score(spark, sf_dir):
    return _star(spark, sf_dir).select("total", "nota_final")


@query("freshness_sla", """
    SELECT event_type, round(age_hours, 6) AS age_hours,
      round(least(10.0, greatest(0.0, 10 * (1 - age_hours / sla))), 6)::DOUBLE AS score, sla::DOUBLE AS sla
    FROM (SELECT 'events' AS event_type, 2000.0 AS sla,
            (epoch(TIMESTAMP '2024-02-01 06:30:00') - epoch(max(ts))) / 3600 AS age_hours FROM events
          UNION ALL SELECT 'events_24h', 24.0, (epoch(TIMESTAMP '2024-02-01 06:30:00') - epoch(max(ts))) / 3600 FROM events)""")
def freshness_sla(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    parts = [star.freshness(events, "ts", AS_OF, sla).withColumns({"event_type": F.lit(name), "sla": F.lit(sla)})
             for name, sla in (("events", 2000.0), ("events_24h", C.SLA_HOURS))]
    return rounded(parts[0].unionByName(parts[1]))


# --- heuristics ---------------------------------------------------------------------------------

_HEURISTIC_DATASETS = ("orders_dirty", "documents", "events")


def rates_sql(dataset: str, name: str, dtype: str, i: int) -> str:
    has = lambda *ts: any(t in name for t in ts)
    text = dtype == "string"
    s = strip(name)
    numeric, temporal = dtype in ("bigint", "int", "double"), dtype == "timestamp_ntz"
    full = f"count({name})"
    plain = float_of(ptbr_plain(name))
    dt = parse_dt(name, True) if text else name
    date_named = has("data", "dt", "date", "updated", "update", "created")
    parts = {
        "dataset": f"'{dataset}'", "ordinal": str(i), "column_name": f"'{name}'", "total": "count(*)", "present": full,
        "email": f"count(*) FILTER (WHERE {EMAIL_SQL.format(x=s)})" if has("email") else "0",
        "date": f"count({parse_dt(name, True)})" if text else full if temporal else "0",
        "number": f"count({plain})" if text else full if numeric else "0",
        "digit": f"count(*) FILTER (WHERE regexp_matches({s}, '[0-9]'))" if text else full,
        "alnum": (f"count(*) FILTER (WHERE regexp_matches({strip(f'{name}::VARCHAR')}, '^[A-Za-z0-9_-]+$'))"
                  if has("id", "codigo", "cd", "cod") else "0"),
        "filled": f"count(*) FILTER (WHERE {s} <> '')" if text else full,
        "latest": f"max({dt})" if date_named and not numeric else "NULL::TIMESTAMP",
        "email_named": str(has("email")), "date_named": str(date_named),
        "id_named": str(has("id", "codigo", "cd", "cod")),
    }
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in parts.items()) + f" FROM {dataset}"


VERDICTS = """
      SELECT *,
        coalesce(CASE WHEN email_named THEN email / nullif(present, 0) END, 0)
          + coalesce(CASE WHEN date_named THEN date / nullif(present, 0) END, 0)
          + coalesce(CASE WHEN digit / nullif(present, 0) >= 0.8 THEN number / nullif(present, 0) END, 0) AS vsum,
        (email_named AND present > 0)::INT + (date_named AND present > 0)::INT
          + coalesce(digit / nullif(present, 0) >= 0.8, FALSE)::INT AS vparts,
        CASE WHEN email_named AND email / present > 0.5 THEN email / present
             WHEN date / present > 0.7 THEN date / present WHEN number / present > 0.7 THEN number / present
             ELSE filled / present END AS chosen,
        CASE WHEN id_named AND present > 0 THEN 0.7 * present / total + 0.3 * alnum / present END AS integrity,
        CASE WHEN date_named THEN date / nullif(present, 0) END AS date_share
      FROM rates"""
_HEURISTIC_CTES = {
    "rates": " UNION ALL ".join(rates_sql(d, c, t, i) for d in _HEURISTIC_DATASETS
                                for i, (c, t) in enumerate(DATASETS[d])),
    "verdicts": VERDICTS,
}


def _rates(spark, sf_dir):
    parts = []
    for d in _HEURISTIC_DATASETS:
        df = orders_dirty(spark, sf_dir) if d == "orders_dirty" else load(spark, sf_dir, d)
        parts.append(heuristics.column_verdicts(heuristics.heuristic_rates(df)).withColumn("dataset", F.lit(d)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _heuristic_sql(body: str) -> str:
    return cte(body, "orders_dirty", **_HEURISTIC_CTES)


@query("heuristic_validity", _heuristic_sql("""
    SELECT dataset, column_name, round(vsum, 6)::DOUBLE AS validity_sum, vparts AS validity_parts FROM verdicts"""))
def heuristic_validity(spark, sf_dir):
    return rounded(_rates(spark, sf_dir).select("dataset", "column_name", "validity_sum", "validity_parts"))


@query("heuristic_consistency", _heuristic_sql("""
    SELECT dataset, column_name, round(greatest(chosen, 1 - chosen), 6)::DOUBLE AS dominant FROM verdicts"""))
def heuristic_consistency(spark, sf_dir):
    return rounded(_rates(spark, sf_dir).select("dataset", "column_name", "dominant"))


@query("heuristic_integrity", _heuristic_sql("""
    SELECT dataset, column_name, round(integrity, 6)::DOUBLE AS integrity FROM verdicts WHERE integrity IS NOT NULL"""))
def heuristic_integrity(spark, sf_dir):
    return rounded(_rates(spark, sf_dir).where(F.col("integrity").isNotNull()).select(
        "dataset", "column_name", "integrity"))


def joined_text(names) -> str:
    return " || '|' || ".join(f"coalesce({n}::VARCHAR, '')" for n in names)


_HEURISTIC_COLUMNS = tuple(c for c, _ in DATASETS["orders_dirty"])
_HEURISTIC_TYPES = dict(DATASETS["orders_dirty"])
_H2 = {
    "orders_part": f"SELECT {', '.join(_HEURISTIC_COLUMNS)} FROM orders_dirty",
    "rates": " UNION ALL ".join(rates_sql("orders_part", c, _HEURISTIC_TYPES[c], i)
                                for i, c in enumerate(_HEURISTIC_COLUMNS)),
    "verdicts": VERDICTS,
    "notes": f"""SELECT (SELECT count(*) FROM orders_part) AS total_registros,
        round({clamp('10 * avg(present / total)')}, 2) AS completude,
        round(10 * (SELECT count(DISTINCT {joined_text(_HEURISTIC_COLUMNS)}) / count(*) FROM orders_part), 2) AS unicidade,
        round({clamp('10 * sum(vsum) / sum(vparts)')}, 2) AS validade,
        round({clamp('10 * avg(greatest(chosen, 1 - chosen))')}, 2) AS consistencia,
        round({clamp('10 * avg(integrity)')}, 2) AS integridade,
        round({clamp("10 * (1 - (epoch(TIMESTAMP '2001-12-10 12:00:00') - epoch(arg_max(latest, "
                     "CASE WHEN date_share >= 0.7 THEN date_share * 1000 - ordinal END))) / 3600 / 24000)")}, 2) AS freshness
      FROM verdicts""",
}


@query("heuristic_scores", cte(
    f"SELECT *, round({STAR_NOTE}, 2) AS nota_final FROM notes", "orders_dirty", **_H2))
def heuristic_scores(spark, sf_dir):
    df = orders_dirty(spark, sf_dir).select(*_HEURISTIC_COLUMNS)
    return heuristics.heuristic_scores(df, ORDERS_AS_OF, 24000.0)
