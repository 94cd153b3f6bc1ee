"""Views over the test tables that carry defects, and score tables measured on them.

The two fixture views are one SQL text that both engines read. Score tables are
measured by the library here and by plain SQL in `cte`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegauge.functions import cells, scoring
from lakegauge.operators import dimensions
from workload.registry import load

ORDERS_DIRTY = """
SELECT o_orderkey, o_custkey, o_orderdate,
  CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000000000 ELSE o_custkey END AS customer_id,
  CASE WHEN o_orderkey % 31 = 0 THEN -o_totalprice ELSE o_totalprice END AS vl_total,
  CASE WHEN o_orderkey % 37 = 0 THEN 'X' WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS dt_pedido,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
       WHEN o_orderkey % 19 = 0 THEN o_orderdate - INTERVAL 1 DAY
       ELSE o_orderdate + INTERVAL 3 DAY END AS dt_entrega,
  CASE WHEN o_orderkey % 23 = 0 THEN '   ' WHEN o_orderkey % 11 = 0 THEN NULL
       ELSE concat('u', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN 'mail.com' ELSE '@mail.com' END)
       END AS email,
  concat(CAST(o_orderkey % 100 AS STRING), ',5', CASE WHEN o_orderkey % 2 = 0 THEN '%' ELSE '' END) AS valor_txt,
  CASE WHEN o_orderkey % 29 = 0 THEN 'n/d' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS data_txt
FROM {orders}
"""

_Y, _M, _D = (f"CAST({p}(o_orderdate) AS STRING)" for p in ("year", "month", "day"))
ORDER_TEXTS = f"""
SELECT o_orderkey, o_custkey,
  CASE CAST(o_orderkey % 10 AS INT)
    WHEN 0 THEN concat({_Y}, '-', {_M}, '-', {_D})
    WHEN 1 THEN concat({_D}, '/', {_M}, '/', {_Y})
    WHEN 2 THEN concat({_Y}, '/', {_M}, '/', {_D})
    WHEN 3 THEN concat({_D}, '-', {_M}, '-', {_Y})
    WHEN 4 THEN concat({_Y}, '-', {_M}, '-', {_D}, ' 12:30:05')
    WHEN 5 THEN concat(' ', {_Y}, '-', {_M}, '-', {_D}, 'T08:00:00')
    WHEN 6 THEN '12:30'
    WHEN 7 THEN {_Y}
    WHEN 8 THEN concat({_M}, '/', {_D}, '/', {_Y}, ' 7:05:09')
    ELSE 'n/d' END AS dt_mix,
  CASE CAST(o_orderkey % 8 AS INT)
    WHEN 0 THEN concat('1.', CAST(100 + o_custkey % 900 AS STRING), ',', CAST(o_orderkey % 100 AS STRING))
    WHEN 1 THEN concat(CAST(o_orderkey % 100 AS STRING), ',5%')
    WHEN 2 THEN concat(CAST(o_custkey AS STRING), '.5')
    WHEN 3 THEN concat('  ', CAST(o_orderkey AS STRING), ' ')
    WHEN 4 THEN ' '
    WHEN 5 THEN concat(CAST(o_orderkey % 10 AS STRING), 'd')
    WHEN 6 THEN NULL
    ELSE concat('-', CAST(o_orderkey % 50 AS STRING), 'e2') END AS number_mix,
  CASE CAST(o_orderkey % 4 AS INT)
    WHEN 0 THEN concat(' ', o_orderpriority, '  Code ')
    WHEN 1 THEN concat('Ação ', o_orderstatus)
    WHEN 2 THEN '%%'
    ELSE concat('Valor Total ', CAST(o_custkey AS STRING)) END AS name_mix,
  CASE WHEN o_orderkey % 12 = 0 THEN concat('U', CAST(o_custkey AS STRING), ', P only')
       WHEN o_orderkey % 41 = 0 THEN NULL
       ELSE concat('U', CAST(o_custkey AS STRING), ', ', o_orderpriority, ' ,', o_orderstatus, ',',
                   CAST(o_orderkey % 1000 AS STRING), ',', CAST(o_orderkey % 7 AS STRING), '%') END AS line
FROM {{orders}}
"""

DETAIL_COLUMNS = ("status", "dt_pedido", "dt_entrega", "email", "valor_txt", "data_txt")


def orders_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORDERS_DIRTY, orders=load(spark, sf_dir, "orders"))


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ORDER_TEXTS, orders=load(spark, sf_dir, "orders"))


def _run_of(df: DataFrame) -> DataFrame:
    year = F.year("o_orderdate")
    return df.withColumn("run_id", F.concat(F.lit("run_"), year.cast("string")))


def _named(groups: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer name and segment; joined after grouping, so no busy customer reaches the join."""
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return groups.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumns({
        "dataset_label": F.col("c_name"), "source_type": F.col("c_mktsegment"),
        "scanned_at": F.concat(F.substr("run_id", F.lit(5)), F.lit("-12-31 00:00:00")).cast("timestamp_ntz"),
    }).drop("o_custkey", "c_custkey", "c_name", "c_mktsegment")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every customer's orders (a dataset) in every year (a run)."""
    df = _run_of(orders_dirty(spark, sf_dir))
    n = F.count(F.lit(1))
    present = sum((F.count(c) for c in DETAIL_COLUMNS[1:]), F.count(DETAIL_COLUMNS[0]))

    def share_bad(bad):
        return scoring.exact_round(scoring.score10(1 - F.count_if(F.coalesce(bad, F.lit(False))) / n), 4)

    groups = df.groupBy("run_id", "o_custkey").agg(
        n.alias("row_count"), F.lit(6).cast("bigint").alias("column_count"),
        scoring.exact_round(scoring.score10(present / (n * len(DETAIL_COLUMNS))), 4).alias("completude"),
        scoring.exact_round(scoring.score10(cells.ratio(F.count_distinct("status"), F.count("status"))), 4).alias("unicidade"),
        share_bad(F.col("dt_pedido") > F.col("dt_entrega")).alias("consistencia"),
        share_bad((F.col("vl_total") < 0) | ~F.col("status").isin("F", "O", "P")).alias("validade"),
        share_bad(F.col("customer_id") != F.col("o_custkey")).alias("integridade"),
        share_bad(F.col("data_txt") == "n/d").alias("freshness"))
    return dimensions.scored(_named(groups, spark, sf_dir))


def score_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of six columns of every customer's orders in every year."""
    df = _run_of(orders_dirty(spark, sf_dir)).select(
        "run_id", "o_custkey", *[F.col(c).cast("string").alias(c) for c in DETAIL_COLUMNS])
    long = df.unpivot(["run_id", "o_custkey"], list(DETAIL_COLUMNS), "column_name", "value")
    groups = long.groupBy("run_id", "o_custkey", "column_name").agg(
        F.count(F.lit(1)).alias("total"), F.count("value").alias("present"),
        F.count_distinct("value").alias("distinct_cnt"))
    metrics = groups.withColumns({
        "nulls": F.col("total") - F.col("present"),
        "null_rate": 1 - F.col("present") / F.col("total"),
        "distinct_ratio": cells.ratio(F.col("distinct_cnt"), F.col("present")),
        "dtype": F.when(F.col("column_name").isin("dt_pedido", "dt_entrega"), "timestamp_ntz").otherwise("string"),
    }).drop("present")
    return dimensions.scored(dimensions.column_dimension_scores(_named(metrics, spark, sf_dir)))


# --- the same tables in SQL -------------------------------------------------------

def clamp(x: str) -> str:
    return f"least(CAST(10 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST({x} AS DOUBLE)))"


def bands(x: str, kind: str = "scan") -> str:
    cuts = {"scan": "WHEN {x} >= 9 THEN 'Excelente' WHEN {x} >= 7 THEN 'Bom' WHEN {x} >= 5 THEN 'Atenção'",
            "report": "WHEN {x} IS NULL THEN 'Sem classificação' WHEN {x} >= 7 THEN 'Bom' WHEN {x} >= 5 THEN 'Atenção'",
            "radar": "WHEN {x} >= 8 THEN 'Excelente' WHEN {x} >= 6 THEN 'Atenção'"}[kind]
    return "CASE " + cuts.format(x=f"({x})") + " ELSE 'Crítico' END"


SCAN_NOTE = ("0.25::DOUBLE*completude + 0.20::DOUBLE*unicidade + 0.15::DOUBLE*consistencia + 0.15::DOUBLE*validade "
             "+ 0.15::DOUBLE*integridade + 0.10::DOUBLE*freshness")
STAR_NOTE = ("0.20::DOUBLE*completude + 0.15::DOUBLE*unicidade + 0.20::DOUBLE*consistencia + 0.15::DOUBLE*validade "
             "+ 0.15::DOUBLE*integridade + 0.15::DOUBLE*freshness")

_PRESENT = " + ".join(f"count({c})" for c in DETAIL_COLUMNS)


def _bad(cond: str) -> str:
    return f"round({clamp(f'10 * (1 - count(*) FILTER (WHERE {cond}) / count(*))')}, 4)"


_CTES = {
    "orders_dirty": ORDERS_DIRTY.format(orders="orders"),
    "order_texts": ORDER_TEXTS.format(orders="orders"),
    "score_groups": f"""
        SELECT concat('run_', year(o_orderdate)::VARCHAR) AS run_id, o_custkey, count(*) AS row_count,
          6::BIGINT AS column_count,
          round({clamp(f'10 * ({_PRESENT}) / (6.0::DOUBLE * count(*))')}, 4) AS completude,
          round({clamp('10 * coalesce(count(DISTINCT status) / nullif(count(status), 0), 0)')}, 4) AS unicidade,
          {_bad('dt_pedido > dt_entrega')} AS consistencia,
          {_bad("vl_total < 0 OR status NOT IN ('F','O','P')")} AS validade,
          {_bad('customer_id <> o_custkey')} AS integridade,
          {_bad("data_txt = 'n/d'")} AS freshness
        FROM orders_dirty GROUP BY 1, 2""",
    "score_notes": f"""
        SELECT * EXCLUDE (o_custkey), round({clamp(SCAN_NOTE)}, 4) AS score, c_name AS dataset_label,
          c_mktsegment AS source_type, (substr(run_id, 5) || '-12-31 00:00:00')::TIMESTAMP AS scanned_at
        FROM score_groups JOIN customer ON o_custkey = c_custkey""",
    "score_summary": f"SELECT * EXCLUDE (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment), "
                     f"{bands('score')} AS classification FROM score_notes",
    "detail_cells": " UNION ALL ".join(
        f"SELECT concat('run_', year(o_orderdate)::VARCHAR) AS run_id, o_custkey, '{c}' AS column_name, "
        f"{c}::VARCHAR AS value FROM orders_dirty" for c in DETAIL_COLUMNS),
    "detail_groups": """
        SELECT run_id, o_custkey, column_name, count(*) AS total, count(DISTINCT value) AS distinct_cnt,
          count(*) - count(value) AS nulls, 1 - count(value) / count(*) AS null_rate,
          coalesce(count(DISTINCT value) / nullif(count(value), 0), 0)::DOUBLE AS distinct_ratio,
          CASE WHEN column_name IN ('dt_pedido', 'dt_entrega') THEN 'timestamp_ntz' ELSE 'string' END AS dtype
        FROM detail_cells GROUP BY 1, 2, 3""",
    "detail_dims": f"""
        SELECT *, round({clamp('10 * (1 - null_rate)')}, 4) AS completude,
          round({clamp('10 * distinct_ratio')}, 4) AS unicidade, 10.0::DOUBLE AS consistencia,
          CASE WHEN nulls < total THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS validade,
          round({clamp('(10 * (1 - null_rate) + 10 * distinct_ratio) / 2')}, 4) AS integridade,
          5.0::DOUBLE AS freshness
        FROM detail_groups""",
    "detail_notes": f"""
        SELECT d.* EXCLUDE (o_custkey), c_name AS dataset_label, c_mktsegment AS source_type,
          (substr(run_id, 5) || '-12-31 00:00:00')::TIMESTAMP AS scanned_at,
          round({clamp(SCAN_NOTE)}, 4) AS score
        FROM detail_dims d JOIN customer ON o_custkey = c_custkey""",
    "score_detail": f"SELECT *, {bands('score')} AS classification FROM detail_notes",
}
_NEEDS = {
    "score_groups": ["orders_dirty"], "score_notes": ["score_groups"], "score_summary": ["score_notes"],
    "detail_cells": ["orders_dirty"], "detail_groups": ["detail_cells"], "detail_dims": ["detail_groups"],
    "detail_notes": ["detail_dims"], "score_detail": ["detail_notes"],
}


def cte(body: str, *names: str, **extra: str) -> str:
    """`body` behind the named views (and what they need), then the extra ones in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    texts = [f"{n} AS ({_CTES[n]})" for n in ordered] + [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH " + ",\n".join(texts) + "\n" if texts else "") + body
