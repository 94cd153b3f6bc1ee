"""KPIs, rankings, history, recommendations over the measured score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakegauge import constants as C
from lakegauge.functions import scoring
from lakegauge.operators import history, rankings, recommend, runs
from workload.profiles import profile_sql
from workload.registry import load, query, rounded
from workload.scores import _CHAIN, _G3, _chain
from workload.tables import bands, cte, score_detail, score_summary

RUN, PREVIOUS = "run_1998", "run_1997"
_THIS = f"(SELECT * FROM score_summary WHERE run_id = '{RUN}')"


def _run(spark, sf_dir, run=RUN):
    return runs.filter_run(score_summary(spark, sf_dir), run)


# --- choosing runs ---------------------------------------------------------------------------

@query("latest_run", cte("""
    SELECT 'scanned_at' AS by, arg_max(run_id, scanned_at) AS run_id FROM score_summary
    UNION ALL SELECT 'run_id', max(run_id) FROM score_summary
    UNION ALL SELECT 'first_table', max(run_id) FROM score_detail""", "score_summary", "score_detail"))
def latest_run(spark, sf_dir):
    s, d = score_summary(spark, sf_dir), score_detail(spark, sf_dir)
    found = [runs.latest_run(s).withColumn("by", F.lit("scanned_at")),
             runs.latest_run(s, "run_id").withColumn("by", F.lit("run_id")),
             runs.first_latest_run([s.where(F.col("score") < 0), d, s]).withColumn("by", F.lit("first_table"))]
    return found[0].unionAll(found[1]).unionAll(found[2]).select("by", "run_id")


@query("latest_run_per_source", """
    SELECT o_custkey, o_orderdate, o_orderkey FROM orders
    WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey)""")
def latest_run_per_source(spark, sf_dir):
    """Orders as a log: the last entries of every customer."""
    return runs.latest_per_source(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select(
        "o_custkey", "o_orderdate", "o_orderkey")


@query("best_label", """
    SELECT o_orderkey, coalesce(nullif(trim(dataset_name), ''), nullif(trim(object_name), ''), nullif(trim(file_name), ''),
      'Dataset não identificado') AS label
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '  ' WHEN o_orderkey % 3 = 1 THEN o_orderpriority END
        AS dataset_name, CASE WHEN o_orderkey % 5 = 0 THEN ' ' || o_orderstatus ELSE '' END AS object_name,
        CASE WHEN o_orderkey % 7 = 0 THEN o_custkey::VARCHAR END AS file_name FROM orders)""")
def best_label(spark, sf_dir):
    key = F.col("o_orderkey")
    df = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, F.col("o_custkey").cast("string")).alias("file_name"),
        F.when(key % 5 == 0, F.concat(F.lit(" "), "o_orderstatus")).otherwise("").alias("object_name"),
        F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.col("o_orderpriority")).alias("dataset_name"))
    return df.select("o_orderkey", runs.best_label(df).alias("label"))


@query("run_summary", cte(f"""
    SELECT run_id, dataset_label, score_final, classification FROM (
      SELECT run_id, dataset_label, round(score, 6) AS score_final, {bands('score', 'report')} AS classification
      FROM score_summary WHERE run_id = '{RUN}')""", "score_summary"))
def run_summary(spark, sf_dir):
    """The first table has no rows of the run; the second lacks label and class, and holds scores as text."""
    full = score_summary(spark, sf_dir).withColumn("run_id", F.col("run_id"))
    texts = full.select("run_id", F.col("dataset_label").alias("object_name"), F.col("score").cast("string").alias("score_final"))
    found = runs.load_run([full.where(F.col("score") < 0), texts], RUN)
    return rounded(found.select("run_id", "dataset_label", "score_final", "classification"))


_DETAIL_MEANS = "SELECT run_id, dataset_label, avg(score) AS score FROM score_detail GROUP BY 1, 2"


@query("summary_from_columns", cte(
    f"SELECT run_id, dataset_label, round(score, 6) AS score, {bands('score', 'report')} AS classification FROM m",
    "score_detail", m=_DETAIL_MEANS))
def summary_from_columns(spark, sf_dir):
    return rounded(runs.summary_from_columns(score_detail(spark, sf_dir)))


@query("dimension_table", cte(
    """SELECT run_id, dataset_label, completude AS dim_completude, unicidade AS dim_unicidade,
      0.0::DOUBLE AS dim_consistencia, validade AS dim_validade, integridade AS dim_integridade_ref,
      freshness AS dim_freshness, score AS score_final FROM score_summary""", "score_summary"))
def dimension_table(spark, sf_dir):
    """One dimension is missing and one is kept as text."""
    s = score_summary(spark, sf_dir).drop("consistencia").withColumn("validade", F.col("validade").cast("string"))
    return runs.dimension_table(s)


# --- KPIs and rankings -------------------------------------------------------------------------

def _kpi_sql(source: str, klass: str = "classification") -> str:
    return f"""
      SELECT *, {bands('score_medio', 'report')} AS classificacao FROM (
      SELECT count(*) AS datasets, round(avg(score), 2) AS score_medio,
        (SELECT dataset_label FROM {source} ORDER BY score DESC, dataset_label LIMIT 1) AS melhor_dataset,
        round(max(score), 2) AS melhor_score,
        (SELECT dataset_label FROM {source} ORDER BY score, dataset_label LIMIT 1) AS pior_dataset,
        round(min(score), 2) AS pior_score, count(*) FILTER (WHERE {klass} = 'Crítico') AS criticos,
        count(*) FILTER (WHERE {klass} = 'Atenção') AS atencao,
        count(*) FILTER (WHERE {klass} IN ('Bom', 'Excelente')) AS aceitaveis FROM {source})"""


@query("run_kpis", cte(_kpi_sql("s"), "score_summary", s=_THIS[1:-1]))
def run_kpis(spark, sf_dir):
    return rankings.kpis(_run(spark, sf_dir))


@query("filtered_kpis", cte(_kpi_sql("s"), "score_summary", s=_THIS[1:-1] + " AND source_type = 'BUILDING'"))
def filtered_kpis(spark, sf_dir):
    return rankings.kpis(runs.filter_run(score_summary(spark, sf_dir), RUN, "BUILDING"))


@query("executive_summary", cte(
    f"""SELECT printf('Foram avaliadas %d fontes de dados, com score executivo médio de %.2f e classificação geral ''%s''. '
      || 'O resultado pede plano de ação priorizado, com foco em consistência, completude e monitoramento contínuo. '
      || 'Foram identificadas %d fontes críticas e %d em atenção.', datasets, score_medio, classificacao, criticos, atencao)
      AS resumo FROM ({_kpi_sql('s')})""", "score_summary", s=_THIS[1:-1]))
def executive_summary(spark, sf_dir):
    return rankings.summary_text(rankings.kpis(_run(spark, sf_dir))).select("resumo")


def _top(name: str, ascending: bool):
    @query(name, cte(f"SELECT dataset_label, score, classification FROM {_THIS} "
                     f"ORDER BY score {'ASC' if ascending else 'DESC'}, dataset_label LIMIT 5", "score_summary"))
    def run(spark, sf_dir):
        return rankings.top_datasets(_run(spark, sf_dir), 5, ascending)
    return run


_top("top_datasets", False)
_top("bottom_datasets", True)


@query("attention_columns", cte(
    f"""SELECT dataset_label, column_name, dtype, score, classification, round(null_rate, 6) AS null_rate,
      round(distinct_ratio, 6) AS distinct_ratio FROM score_detail WHERE run_id = '{RUN}'
    ORDER BY score, dataset_label, column_name LIMIT 20""", "score_detail"))
def attention_columns(spark, sf_dir):
    return rounded(rankings.attention(runs.filter_run(score_detail(spark, sf_dir), RUN)))


@query("ranked_scores", cte(
    f"SELECT dataset_label, score FROM {_THIS} ORDER BY score DESC, dataset_label", "score_summary"))
def ranked_scores(spark, sf_dir):
    return rankings.ranked(_run(spark, sf_dir), "dataset_label").select("dataset_label", "score")


@query("score_history", cte(
    "SELECT run_id, round(avg(score), 6) AS avg_score FROM score_summary GROUP BY run_id", "score_summary"))
def score_history(spark, sf_dir):
    return rounded(rankings.history(score_summary(spark, sf_dir)))


@query("score_history_by_time", cte(
    "SELECT scanned_at, round(avg(score), 6) AS score_overall FROM score_summary GROUP BY scanned_at", "score_summary"))
def score_history_by_time(spark, sf_dir):
    return rounded(rankings.history(score_summary(spark, sf_dir), "scanned_at", "score_overall"))


@query("metric_report", profile_sql(
    """SELECT object_name, metrica, CASE WHEN v IS NULL THEN '-'
        ELSE regexp_replace(printf('%.2f', v), '\\.?0+$', '') END AS valor, CASE metrica
        WHEN 'score_final' THEN 'qualidade geral do dataset'
        WHEN 'score_completeness' THEN 'poucos valores nulos (completude)'
        WHEN 'score_uniqueness' THEN 'boa diversidade de valores (unicidade)'
        WHEN 'score_volume' THEN 'volume de linhas (amostra)' WHEN 'null_rate' THEN 'percentual de células nulas'
        ELSE 'unicidade média das colunas' END AS significado
    FROM (UNPIVOT (SELECT object_name, score_final, score_completeness, score_uniqueness, score_volume, null_rate,
            avg_distinct_ratio FROM g3_t ORDER BY score_final DESC, object_name LIMIT 1)
          ON COLUMNS(* EXCLUDE object_name) INTO NAME metrica VALUE v)""", _CHAIN, g3_t=_G3["g3_t"]))
def metric_report(spark, sf_dir):
    return rankings.metric_report(_chain(spark, sf_dir)[0])


@query("score_matrix", cte(
    """SELECT 'volume' AS form, run_id, dataset_label, row_count::DOUBLE AS row_count, score FROM score_summary
    UNION ALL SELECT 'index', run_id, dataset_label, (row_number() OVER (ORDER BY run_id, dataset_label))::DOUBLE, score
      FROM score_summary""", "score_summary"))
def score_matrix(spark, sf_dir):
    s = score_summary(spark, sf_dir)
    volume = rankings.score_matrix(s).withColumn("form", F.lit("volume"))
    index = rankings.score_matrix(s.drop("row_count")).withColumn("form", F.lit("index"))
    return volume.unionByName(index)


@query("run_comparison", cte(" UNION ALL ".join(
    f"""SELECT c.dataset_label, '{d}' AS dimension, c.{d} AS atual, p.{d} AS anterior, round(c.{d} - p.{d}, 6) AS delta
    FROM {_THIS} c LEFT JOIN (SELECT * FROM score_summary WHERE run_id = '{PREVIOUS}') p USING (dataset_label)"""
    for d in C.DIMENSIONS), "score_summary"))
def run_comparison(spark, sf_dir):
    from lakegauge.operators.dimensions import to_long
    long = to_long(score_summary(spark, sf_dir), ["run_id", "dataset_label"])
    return rounded(runs.compare_runs(long, RUN, PREVIOUS, "dataset_label"))


@query("filtered_dimensions", cte(" UNION ALL ".join(
    f"SELECT run_id, dataset_label AS dataset_name, '{d}' AS dimension, {d} AS score FROM {_THIS} "
    f"WHERE source_type = 'BUILDING'" for d in C.DIMENSIONS), "score_summary"))
def filtered_dimensions(spark, sf_dir):
    from lakegauge.operators.dimensions import to_long
    s = score_summary(spark, sf_dir).withColumn("dataset_name", F.col("dataset_label"))
    chosen = runs.filter_run(s, RUN, "BUILDING")
    return runs.filter_run(to_long(s, ["run_id", "dataset_name"]), RUN, datasets=chosen)


# --- recommendations ---------------------------------------------------------------------------

@query("threshold_advice", cte(
    """SELECT run_id, dataset_label, column_name, CASE WHEN null_rate > 0.2::DOUBLE THEN
      'Alta quantidade de nulos. Recomenda-se validação obrigatória na origem.' WHEN 1 - distinct_ratio > 0.05::DOUBLE
      THEN 'Duplicidade detectada. Implementar chave única.' ELSE 'Sem problemas críticos.' END AS advice
    FROM score_detail""", "score_detail"))
def threshold_advice(spark, sf_dir):
    return score_detail(spark, sf_dir).select(
        "run_id", "dataset_label", "column_name",
        scoring.threshold_advice(F.col("null_rate"), 1 - F.col("distinct_ratio")).alias("advice"))


_REVIEW = """SELECT '{run}' AS run_id, 'Alta' AS prioridade, dataset_label,
      printf('Revisar a coluna %s do dataset %s.', column_name, dataset_label) AS recomendacao
    FROM (SELECT * FROM score_detail WHERE run_id = '{run}' ORDER BY score, dataset_label, column_name LIMIT 10)"""
_NO_REVIEW = """SELECT 'run_0' AS run_id, 'Média' AS prioridade, '' AS dataset_label,
      'Nenhuma recomendação disponível para o run atual.' AS recomendacao"""


@query("review_recommendations", cte(
    _REVIEW.format(run=RUN) + " UNION ALL " + _NO_REVIEW, "score_detail"))
def review_recommendations(spark, sf_dir):
    detail = score_detail(spark, sf_dir)
    parts = [recommend.review_recommendations(runs.filter_run(detail, run), run) for run in (RUN, "run_0")]
    return parts[0].unionByName(parts[1])


@query("priority_score", cte(
    """SELECT run_id, dataset_label, score, prioridade,
      CASE WHEN prioridade >= 15 THEN 'Imediata' WHEN prioridade >= 10 THEN 'Alta' WHEN prioridade >= 6 THEN 'Média'
        ELSE 'Baixa' END AS faixa
    FROM (SELECT run_id, dataset_label, score, (CASE WHEN classification = 'Crítico' THEN 5 ELSE 1 END
      + floor(10 - validade) + floor(10 - completude) + CASE WHEN freshness < 10 THEN 2 ELSE 0 END
      + CASE WHEN row_count = 1 THEN 1 ELSE 0 END)::INTEGER AS prioridade FROM score_summary)""", "score_summary"))
def priority_score(spark, sf_dir):
    s = score_summary(spark, sf_dir)
    value = scoring.priority_score(
        F.when(F.col("classification") == "Crítico", 5).otherwise(1), F.floor(10 - F.col("validade")).cast("int"),
        F.floor(10 - F.col("completude")).cast("int"), F.when(F.col("freshness") < 10, 2).otherwise(0),
        F.when(F.col("row_count") == 1, 1).otherwise(0))
    return s.select("run_id", "dataset_label", "score", value.alias("prioridade")).withColumn(
        "faixa", scoring.priority_band(F.col("prioridade")))


_LABELS = {"Atualidade": "freshness", "Completude": "completude", "Consistência": "consistencia",
           "Integridade": "integridade", "Unicidade": "unicidade", "Validade": "validade"}
_LEAST = "least(" + ", ".join(_LABELS.values()) + ")"
_LOWEST = "CASE " + " ".join(f"WHEN {c} = {_LEAST} THEN '{label}'" for label, c in _LABELS.items()) + " END"


def _advice(which: int) -> str:
    return "CASE lowest_dimension " + " ".join(
        f"WHEN '{d}' THEN '{a[which]}'" for d, a in C.DIMENSION_ADVICE.items()) + " END"


@query("lowest_dimension_advice", cte(
    f"""SELECT run_id, dataset_label, lowest_dimension, {_advice(0)} AS root_cause, {_advice(1)} AS recommendation
    FROM (SELECT *, {_LOWEST} AS lowest_dimension FROM score_summary)""", "score_summary"))
def lowest_dimension_advice(spark, sf_dir):
    return recommend.lowest_dimension_advice(score_summary(spark, sf_dir)).select(
        "run_id", "dataset_label", "lowest_dimension", "root_cause", "recommendation")


# Recommendation texts taken from the documents' own vocabulary would never hit a keyword,
# so the texts are composed from order fields.
_REC_TEXT = """
SELECT o_orderkey, concat('run_', CAST(year(o_orderdate) AS STRING)) AS run_id,
  CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 2 = 0 THEN 'Alta' ELSE 'media' END AS prioridade,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat(' ', o_orderpriority) END AS dataset_label,
  CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'Tratar valores NULOS' WHEN 1 THEN 'Registros duplicados'
    WHEN 2 THEN 'Formato inválido' WHEN 3 THEN 'Fora da faixa' WHEN 4 THEN 'Carga pouco recente'
    WHEN 5 THEN 'Missing pattern' WHEN 6 THEN NULL ELSE 'Rever processo ' END AS recomendacao
FROM {orders}
"""
_FILLED = """SELECT o_orderkey, run_id, coalesce(nullif(trim(prioridade), ''), 'Não definida') AS prioridade,
    coalesce(nullif(trim(dataset_label), ''), 'Não informado') AS dataset_label,
    coalesce(trim(recomendacao), '') AS recomendacao, lower(coalesce(recomendacao, '')) AS t FROM recs"""
_THEMED = "SELECT * EXCLUDE (t), CASE " + " ".join(
    f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{theme}'" for theme, words in C.THEME_KEYWORDS
) + " ELSE 'Qualidade Geral' END AS tema FROM filled"
_REC_CTES = {"recs": _REC_TEXT.format(orders="orders"), "filled": _FILLED, "themed": _THEMED}


def _themed(spark, sf_dir):
    return recommend.with_theme(spark.sql(_REC_TEXT, orders=load(spark, sf_dir, "orders")))


@query("recommendation_theme", cte("SELECT * FROM themed", **_REC_CTES))
def recommendation_theme(spark, sf_dir):
    return _themed(spark, sf_dir)


@query("recommendation_head", cte(
    """SELECT prioridade, dataset_label, tema, recomendacao, o_orderkey FROM themed
    ORDER BY dataset_label, o_orderkey LIMIT 30""", **_REC_CTES))
def recommendation_head(spark, sf_dir):
    """The first 30 recommendations of the report table."""
    return _themed(spark, sf_dir).orderBy("dataset_label", "o_orderkey").limit(30).select(
        "prioridade", "dataset_label", "tema", "recomendacao", "o_orderkey")


for _name, _by in (("rec_counts_by_theme", "tema"), ("rec_counts_by_priority", "prioridade")):
    def _counts(spark, sf_dir, by=_by):
        return recommend.rec_counts(_themed(spark, sf_dir), by)
    query(_name, cte(f"SELECT {_by}, count(*) AS quantidade FROM themed GROUP BY 1", **_REC_CTES))(_counts)


@query("rec_counts_by_dataset", cte(
    """SELECT dataset_label, count(*) AS quantidade FROM score_detail WHERE classification = 'Crítico'
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", "score_detail"))
def rec_counts_by_dataset(spark, sf_dir):
    critical = score_detail(spark, sf_dir).where(F.col("classification") == "Crítico")
    return recommend.rec_counts(critical, "dataset_label", 10)


@query("rec_totals", cte(
    """SELECT count(*) AS total, count(*) FILTER (WHERE lower(prioridade) = 'alta') AS alta,
      count(*) FILTER (WHERE lower(prioridade) IN ('média', 'media')) AS media,
      count(DISTINCT dataset_label) AS datasets FROM themed""", **_REC_CTES))
def rec_totals(spark, sf_dir):
    return recommend.rec_totals(_themed(spark, sf_dir))


# --- history tables ------------------------------------------------------------------------------

@query("run_history", cte(
    f"""SELECT run_id, run_timestamp, NULL::VARCHAR AS source_schema, datasets_count, columns_scanned, overall_score,
      {bands('overall_score', 'report')} AS overall_classification, NULL::VARCHAR AS report_excel_path,
      NULL::VARCHAR AS report_html_path, NULL::VARCHAR AS radar_html_path, NULL::VARCHAR AS history_html_path
    FROM (SELECT run_id, max(scanned_at) AS run_timestamp, count(*) AS datasets_count,
      sum(column_count)::BIGINT AS columns_scanned, round(avg(score), 2) AS overall_score
      FROM score_summary GROUP BY run_id)""", "score_summary"))
def run_history(spark, sf_dir):
    return history.run_history(score_summary(spark, sf_dir))


@query("dataset_score_history", cte(
    """SELECT run_id, scanned_at AS run_timestamp, dataset_label AS dataset_name, source_type,
      NULL::VARCHAR AS source_ref, NULL::VARCHAR AS object_name, score AS score_overall,
      classification AS classification_overall, completude AS score_completeness, consistencia AS score_consistency,
      unicidade AS score_uniqueness, validade AS score_validity, freshness AS score_timeliness,
      integridade AS score_integrity, round((10 - score) * (1 + coalesce(crit / cols, 0)), 4) AS priority_index,
      coalesce(crit, 0) AS critical_columns_count
    FROM score_summary LEFT JOIN (SELECT run_id, dataset_label, count(*) AS cols,
      count(*) FILTER (WHERE classification = 'Crítico') AS crit FROM score_detail GROUP BY 1, 2)
      USING (run_id, dataset_label)""", "score_summary", "score_detail"))
def dataset_score_history(spark, sf_dir):
    return history.dataset_history(score_summary(spark, sf_dir), score_detail(spark, sf_dir))


@query("dimension_score_history", cte(" UNION ALL ".join(
    f"SELECT run_id, scanned_at AS run_timestamp, dataset_label AS dataset_name, '{d}' AS dimension_name, "
    f"{d} AS dimension_score FROM score_summary" for d in C.DIMENSIONS), "score_summary"))
def dimension_score_history(spark, sf_dir):
    return history.dimension_history(score_summary(spark, sf_dir))


_GAP = "(CASE WHEN {k} = 'Crítico' THEN 5 ELSE 3 END + 2 * floor(10 - score))::DOUBLE"


@query("prioritized_recommendations", cte(
    f"""SELECT sha256(concat_ws('|', run_id, dataset_name, column_name, recommendation_type)) AS recommendation_id,
      run_id, run_timestamp, dataset_name, column_name, recommendation_level, recommendation_type,
      root_cause_hypothesis, recommendation_text, priority_score, CASE WHEN priority_score >= 15 THEN 'Imediata'
        WHEN priority_score >= 10 THEN 'Alta' WHEN priority_score >= 6 THEN 'Média' ELSE 'Baixa' END AS priority_band
    FROM (SELECT run_id, scanned_at AS run_timestamp, dataset_label AS dataset_name, '' AS column_name,
        'dataset' AS recommendation_level, lowest_dimension AS recommendation_type,
        {_advice(0)} AS root_cause_hypothesis, {_advice(1)} AS recommendation_text,
        {_GAP.format(k='classification')} AS priority_score
      FROM (SELECT *, {_LOWEST} AS lowest_dimension FROM score_summary WHERE classification IN ('Crítico', 'Atenção'))
      UNION ALL SELECT run_id, scanned_at, dataset_label, column_name, 'column', 'Revisão',
        'Causa raiz ainda não classificada.', printf('Revisar a coluna %s do dataset %s.', column_name, dataset_label),
        5 + 2 * floor(10 - score) FROM score_detail WHERE classification = 'Crítico')""", "score_summary", "score_detail"))
def prioritized_recommendations(spark, sf_dir):
    recs = history.recommendation_history(score_summary(spark, sf_dir), score_detail(spark, sf_dir))
    return recs.drop("expected_benefit", "estimated_effort", "estimated_impact", "owner_suggestion", "implementation_hint")
