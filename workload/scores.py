"""Dimension scores, table and column scores, classes, and the chain of scores from metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge import constants as C
from lakegauge.functions import scoring
from lakegauge.operators import chain, dimensions as dims, profile as prof, rules
from lakegauge.plans import scan
from lakegauge.session import work_path
from workload.checks import ESTIMATE_SQL, SUITE
from workload.profiles import DATASETS, profile_sql, profiles
from workload.registry import load, query, rounded
from workload.tables import SCAN_NOTE, STAR_NOTE, bands, clamp, cte, score_detail, score_summary

_ID = "regexp_matches(column_name, '(^id$|^id_|_id$|codigo|chave|key)', 'i')"
_DATE = "regexp_matches(column_name, 'date|data|dt_|_dt|timestamp|measured_at|created|updated', 'i')"
_THERE = "(total - nulls)"
_COMPLETUDE = clamp("10 * (1 - sum(nulls) / sum(total))")
_UNICIDADE = clamp(f"10 * avg(CASE WHEN {_THERE} = 0 THEN 1 ELSE distinct_ratio END)")
_DIM_SQL = {
    "completude": _COMPLETUDE,
    "unicidade": _UNICIDADE,
    "consistencia": "10.0::DOUBLE",
    "validade": clamp(f"10 * avg(CASE WHEN {_THERE} = 0 OR kind <> 'text' THEN 1 ELSE non_blank / {_THERE} END)"),
    "integridade": f"CASE WHEN count(*) FILTER (WHERE {_ID}) > 0 THEN "
                   + clamp(f"10 * avg(({_THERE} / total + distinct_ratio) / 2) FILTER (WHERE {_ID})")
                   + f" ELSE ({_COMPLETUDE} + {_UNICIDADE}) / 2 END",
    "freshness": f"CASE WHEN count(*) FILTER (WHERE {_DATE}) > 0 THEN "
                 + clamp(f"10 * max(CASE WHEN kind = 'temporal' THEN {_THERE} / total "
                         f"ELSE coalesce(parse_ok, 0) / total END) FILTER (WHERE {_DATE})") + " ELSE 5.0::DOUBLE END",
}
_ALL_DIMS = ", ".join(f"round({sql}, 4) AS {d}" for d, sql in _DIM_SQL.items())
_T = {"t": f"SELECT dataset, max(total) AS row_count, count(*) AS column_count, {_ALL_DIMS} FROM p GROUP BY dataset"}


def _dimension_query(name: str, dimension: str):
    @query(name, profile_sql(f"SELECT dataset, {dimension} FROM t", **_T))
    def run(spark, sf_dir):
        # completeness and freshness need no distinct counts, so none are made
        exact = "exact" if dimension in ("unicidade", "integridade") else "none"
        p = profiles(spark, sf_dir, distinct=exact)
        return dims.dimension_scores(p, "dataset", only=(dimension,)).select("dataset", dimension)
    return run


for _name, _dimension in (("dim_completeness", "completude"), ("dim_uniqueness", "unicidade"),
                          ("dim_validity", "validade"), ("dim_integrity", "integridade"),
                          ("dim_date_parseability", "freshness")):
    _dimension_query(_name, _dimension)

_JSON_KIND = """CASE WHEN {c} IS NULL THEN NULL WHEN json_valid({c}) THEN CASE json_type({c}::JSON)
    WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE json_type({c}::JSON) END
    ELSE 'TEXT' END"""
_MIXED = ("CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS STRING) WHEN event_id % 7 = 0 THEN event_type "
          "WHEN event_id % 11 = 0 THEN 'true' WHEN event_id % 13 = 0 THEN NULL ELSE props END")


def _types_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, count(DISTINCT {_JSON_KIND.format(c=c)})::INTEGER AS type_count FROM mixed")


@query("dim_type_consistency", cte(
    """SELECT column_name, type_count, greatest(0.0::DOUBLE, 1 - (type_count - 1) * 0.25::DOUBLE) * 10 AS consistencia
    FROM k""", mixed=f"SELECT props, event_type, {_MIXED} AS mixed FROM events",
    k=" UNION ALL ".join(_types_sql(c) for c in ("props", "event_type", "mixed"))))
def dim_type_consistency(spark, sf_dir):
    """Text columns judged by the JSON types found in their cells."""
    df = load(spark, sf_dir, "events").select("props", "event_type", F.expr(_MIXED).alias("mixed"))
    p = prof.profile(df, distinct="none", lexical=True)
    return dims.dimension_scores(p, "column_name", only=("consistencia",)).join(
        p.select("column_name", "type_count"), "column_name").select("column_name", "type_count", "consistencia")


@query("table_dimension_scores", profile_sql("SELECT * FROM t", **_T))
def table_dimension_scores(spark, sf_dir):
    return dims.dimension_scores(profiles(spark, sf_dir), "dataset")


@query("table_scores", profile_sql(
    f"SELECT *, {bands('score')} AS classification, 6::BIGINT AS dimension_count "
    f"FROM (SELECT *, round({SCAN_NOTE}, 4) AS score FROM t)", **_T))
def table_scores(spark, sf_dir):
    return scan.table_scores(profiles(spark, sf_dir), "dataset")


_COLUMN_DIMS = {"d": f"""
    SELECT dataset, column_name, round({clamp('10 * (1 - null_rate)')}, 4) AS completude,
      round({clamp('10 * distinct_ratio')}, 4) AS unicidade, 10.0::DOUBLE AS consistencia,
      CASE WHEN total = 0 OR nulls < total THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS validade,
      round({clamp('(10 * (1 - null_rate) + 10 * distinct_ratio) / 2')}, 4) AS integridade,
      5.0::DOUBLE AS freshness FROM p"""}


@query("column_dimension_scores", profile_sql("SELECT * FROM d", **_COLUMN_DIMS))
def column_dimension_scores(spark, sf_dir):
    return dims.column_dimension_scores(profiles(spark, sf_dir)).select("dataset", "column_name", *C.DIMENSIONS)


@query("column_scores", profile_sql(
    f"SELECT dataset, column_name, score, {bands('score')} AS classification "
    f"FROM (SELECT *, round({SCAN_NOTE}, 4) AS score FROM d)", **_COLUMN_DIMS))
def column_scores(spark, sf_dir):
    return scan.column_scores(profiles(spark, sf_dir)).select("dataset", "column_name", "score", "classification")


@query("volume_score", profile_sql("""
    SELECT dataset, max(total) AS row_count, CASE WHEN max(total) >= 1000 THEN 10.0 WHEN max(total) >= 100 THEN 7.0
      WHEN max(total) >= 10 THEN 4.0 ELSE 1.0 END::DOUBLE AS score_volume FROM p GROUP BY dataset"""))
def volume_score(spark, sf_dir):
    m = prof.table_metrics(profiles(spark, sf_dir, distinct="none"), "dataset")
    return m.select("dataset", F.col("sample_rows").alias("row_count"),
                    scoring.volume_score(F.col("sample_rows")).alias("score_volume"))


# --- chain ---------------------------------------------------------------------------------

_CHAIN = ("orders_dirty", "lineitem", "events")
_G3 = {
    "g3_t": f"""
      SELECT *, {clamp('0.6::DOUBLE*score_completeness + 0.3::DOUBLE*score_uniqueness + 0.1::DOUBLE*score_volume')}
        AS score_final
      FROM (SELECT dataset AS object_name, max(total) AS sample_rows, sum(nulls) / sum(total) AS null_rate,
        avg(distinct_ratio) AS avg_distinct_ratio, (1 - sum(nulls) / sum(total)) * 10 AS score_completeness,
        avg(distinct_ratio) * 10 AS score_uniqueness,
        CASE WHEN max(total) >= 1000 THEN 10.0 WHEN max(total) >= 100 THEN 7.0
             WHEN max(total) >= 10 THEN 4.0 ELSE 1.0 END::DOUBLE AS score_volume
      FROM p GROUP BY dataset)""",
    "g3_e": ESTIMATE_SQL.replace("FROM p", "FROM p").replace(
        "WHEN column_name IN", "WHEN dataset = 'orders_dirty' AND column_name IN"),
    "g3_c": f"""
      SELECT *, {clamp('score_base + score_rules')} AS score_final,
        {clamp('score_base_bug + score_rules')} AS score_final_bug
      FROM (SELECT dataset AS object_name, column_name, total, violations,
          {clamp('0.7::DOUBLE * ((1 - null_rate) * 10) + 0.3::DOUBLE * (distinct_ratio * 10)')} AS score_base,
          {clamp('0.7::DOUBLE * ((1 - CASE WHEN null_rate = 0 THEN 1 ELSE null_rate END) * 10) '
                 '+ 0.3::DOUBLE * (distinct_ratio * 10)')} AS score_base_bug,
          CASE WHEN violations = 0 THEN 0 WHEN violations / total > 0.30 THEN -6
               WHEN violations / total > 0.10 THEN -4 ELSE -2 END::DOUBLE AS score_rules FROM g3_e)""",
    "g3_r": f"""
      SELECT t.object_name, t.score_final AS score_base, coalesce(penalty, 0) AS rules_penalty_avg,
        {clamp('t.score_final + coalesce(penalty, 0)')} AS score_final
      FROM g3_t t LEFT JOIN (SELECT object_name, avg(score_rules) AS penalty FROM g3_c GROUP BY 1) USING (object_name)""",
    "g3_d": f"""
      SELECT t.object_name, score_completeness AS completude, score_uniqueness AS unicidade, c_final AS consistencia,
        c_base AS validade, {clamp('10 + c_rules')} AS integridade, 0.0::DOUBLE AS freshness
      FROM g3_t t LEFT JOIN (SELECT object_name, avg(score_final) AS c_final, avg(score_base) AS c_base,
        avg(score_rules) AS c_rules FROM g3_c GROUP BY 1) USING (object_name)""",
}


def _keyed(spark, sf_dir):
    """The profile as a run would store it: measured once, read by every step of the chain."""
    path = work_path(spark, "profile")
    profiles(spark, sf_dir, _CHAIN).withColumnRenamed("dataset", "object_name").withColumns(
        {"run_id": F.lit("run"), "source_type": F.lit("file"), "source_ref": F.lit("testdata")}).write.parquet(path)
    return spark.read.parquet(path)


def _chain_sql(body: str) -> str:
    return profile_sql(body, _CHAIN, **_G3)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query("g3_table_scores", _chain_sql(
    "SELECT object_name, sample_rows, "
    + _r("null_rate", "avg_distinct_ratio", "score_completeness", "score_uniqueness", "score_volume", "score_final")
    + " FROM g3_t"))
def g3_table_scores(spark, sf_dir):
    return rounded(chain.table_scores(_keyed(spark, sf_dir)).drop("run_id", "source_type", "source_ref"))


@query("g3_column_scores", _chain_sql(
    "SELECT object_name, column_name, total, violations, "
    + _r("score_base", "score_rules", "score_final", "score_base_bug", "score_final_bug") + " FROM g3_c"))
def g3_column_scores(spark, sf_dir):
    p, r = _keyed(spark, sf_dir), rules.rules_table(spark, SUITE)
    keys = ["object_name", "column_name"]
    bug = chain.column_scores(p, r, zero_null_bug=True).select(
        *keys, F.col("score_base").alias("score_base_bug"), F.col("score_final").alias("score_final_bug"))
    return rounded(chain.column_scores(p, r).select(
        *keys, "total", "violations", "score_base", "score_rules", "score_final").join(bug, keys))


def _chain(spark, sf_dir):
    p, r = _keyed(spark, sf_dir), rules.rules_table(spark, SUITE)
    return chain.table_scores(p), chain.column_scores(p, r)


@query("g3_table_scores_with_rules", _chain_sql(
    "SELECT object_name, " + _r("score_base", "rules_penalty_avg", "score_final") + " FROM g3_r"))
def g3_table_scores_with_rules(spark, sf_dir):
    return rounded(chain.table_scores_with_rules(*_chain(spark, sf_dir)).select(
        "object_name", "score_base", "rules_penalty_avg", "score_final"))


_G3_DIMS = ("completude AS dim_completude", "unicidade AS dim_unicidade", "consistencia AS dim_consistencia",
            "validade AS dim_validade", "integridade AS dim_integridade_ref", "freshness AS dim_freshness")
_G3_SELECT = ", ".join("round({}, 6) AS {}".format(*x.split(" AS ")) for x in _G3_DIMS)


@query("g3_dimension_scores", _chain_sql(f"""
    SELECT 'weighted' AS final, object_name, {_G3_SELECT}, round({clamp(STAR_NOTE)}, 6) AS score_final FROM g3_d
    UNION ALL SELECT 'official', object_name, {_G3_SELECT}, round(score_final, 6) FROM g3_d
      JOIN (SELECT object_name, score_final FROM g3_r) USING (object_name)"""))
def g3_dimension_scores(spark, sf_dir):
    tables, columns = _chain(spark, sf_dir)
    weighted = chain.dimension_table(tables, columns).withColumn("final", F.lit("weighted"))
    official = chain.dimension_table(tables, columns, chain.table_scores_with_rules(tables, columns)).withColumn(
        "final", F.lit("official"))
    return rounded(weighted.unionByName(official).drop("run_id", "source_type", "source_ref"))


# --- bands, weights, wide and long ------------------------------------------------------------

def _class_query(name: str, kind: str):
    @query(name, f"SELECT score, {bands('score', kind)} AS classification, count(*) AS n "
                 f"FROM (SELECT (o_custkey % 101) / 10 AS score FROM orders) GROUP BY ALL")
    def run(spark, sf_dir):
        score = (F.col("o_custkey") % 101) / 10
        return load(spark, sf_dir, "orders").groupBy(
            score.alias("score"), scoring.classify(score, kind).alias("classification")).agg(F.count(F.lit(1)).alias("n"))
    return run


_class_query("classify", "scan")
_class_query("classify_report", "report")


@query("radar_status", cte(
    f"SELECT run_id, dataset_label, round(m, 6) AS media, {bands('m', 'radar')} AS status FROM "
    "(SELECT run_id, dataset_label, (completude + unicidade + consistencia + validade + integridade + freshness) / 6 AS m "
    "FROM score_summary)", "score_summary"))
def radar_status(spark, sf_dir):
    from lakegauge.operators.rankings import radar_status as status
    long = dims.to_long(score_summary(spark, sf_dir), ["run_id", "dataset_label"])
    return rounded(status(long, "run_id", "dataset_label"))


@query("weighted_rule_score", cte(
    """SELECT run_id, round(sum(score * total) / sum(total), 6) AS score FROM score_detail GROUP BY run_id""",
    "score_detail"))
def weighted_rule_score(spark, sf_dir):
    return rounded(dims.weighted_mean(score_detail(spark, sf_dir), "score", "total", "run_id"))


@query("weighted_dimension_score", cte(
    """SELECT run_id, dataset_label, round((0.25::DOUBLE * completude + 0.20::DOUBLE * unicidade
      + 0.15::DOUBLE * consistencia + 0.15::DOUBLE * validade) / 1.0, 6) AS score FROM score_summary""", "score_summary"))
def weighted_dimension_score(spark, sf_dir):
    long = dims.to_long(score_summary(spark, sf_dir), ["run_id", "dataset_label"], C.DIMENSIONS[:4])
    return rounded(dims.weighted_dimensions(long, C.WEIGHTS["scan"], "run_id", "dataset_label"))


@query("dimension_averages", cte(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, round(avg({d}), 6) AS score FROM score_summary" for d in C.DIMENSIONS), "score_summary"))
def dimension_averages(spark, sf_dir):
    return rounded(dims.dimension_averages(score_summary(spark, sf_dir)))


_LONG = " UNION ALL ".join(f"SELECT run_id, dataset_label, '{d}' AS dimension, {d} AS score FROM score_summary"
                           for d in C.DIMENSIONS)


@query("dimension_unpivot", cte(_LONG, "score_summary"))
def dimension_unpivot(spark, sf_dir):
    return dims.to_long(score_summary(spark, sf_dir), ["run_id", "dataset_label"])


@query("dimension_pivot", cte(
    "SELECT source_type, " + ", ".join(f"round(avg({d}), 6) AS {d}" for d in C.DIMENSIONS)
    + " FROM score_summary GROUP BY source_type", "score_summary"))
def dimension_pivot(spark, sf_dir):
    long = dims.to_long(score_summary(spark, sf_dir), ["source_type", "dataset_label"])
    return rounded(dims.to_wide(long, ["source_type"]))


@query("classification_distribution", cte(
    "SELECT classification, count(*) AS quantidade FROM score_summary GROUP BY classification", "score_summary"))
def classification_distribution(spark, sf_dir):
    return prof.value_counts(score_summary(spark, sf_dir), "classification")
