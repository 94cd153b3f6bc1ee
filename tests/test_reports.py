"""Choosing runs, KPIs, rankings, recommendations and history tables."""

from datetime import datetime

from pyspark.sql import functions as F

from lakegauge import constants as C
from lakegauge.operators import history, rankings, recommend, runs

AT = datetime(2024, 1, 1)


def scores(spark, rows):
    return spark.createDataFrame(rows, "run_id string, dataset_label string, score double, source_type string")


def test_kpis_of_nothing(spark):
    k = rankings.kpis(scores(spark, [])).first()
    assert tuple(k) == (0, 0.0, C.NO_BAND, C.NO_DATA, 0.0, C.NO_DATA, 0.0, 0, 0, 0)
    assert "Foram avaliadas 0 fontes" in rankings.summary_text(rankings.kpis(scores(spark, []))).first().resumo


def test_kpis_ties_by_name(spark):
    k = rankings.kpis(scores(spark, [("r", "b", 8.0, "x"), ("r", "a", 8.0, "x"), ("r", "c", 2.0, "x"), ("r", "d", 2.0, "x"),
                                     ("r", "e", None, "x")])).first()
    assert (k.melhor_dataset, k.pior_dataset, k.pior_score, k.score_medio) == ("a", "e", 0.0, 4.0)
    assert (k.datasets, k.criticos, k.atencao, k.aceitaveis) == (5, 3, 0, 2)


def test_latest_run(spark):
    df = spark.createDataFrame([("r9", datetime(2024, 1, 1)), ("r1", datetime(2024, 2, 1)), (None, datetime(2025, 1, 1))],
                               "run_id string, scanned_at timestamp_ntz")
    assert runs.latest_run(df).first().run_id == "r1"
    assert runs.latest_run(df, "run_id").first().run_id == "r9"
    assert runs.first_latest_run([df.where("false"), df]).first().run_id == "r9"


def test_latest_per_source_keeps_ties(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", 1, "w")],
                                "source_file string, run_ts int, t string")
    assert {r.t for r in runs.latest_per_source(log).collect()} == {"y", "z", "w"}


def test_load_run_falls_back(spark):
    empty = scores(spark, [])
    second = spark.createDataFrame([("r", " ", "t", "7.5"), ("r", None, "u", "x")],
                                   "run_id string, dataset_name string, object_name string, score_base string")
    got = {r.dataset_label: (r.score_base, r.classification) for r in runs.load_run([empty, second], "r").collect()}
    assert got == {"t": (7.5, "Bom"), "u": (0.0, "Crítico")}
    detail = spark.createDataFrame([("q", "t", "c1", 4.0), ("q", "t", "c2", 8.0)],
                                   "run_id string, dataset_label string, column_name string, score double")
    got = runs.load_run([empty, second], "q", detail).collect()
    assert [(r.dataset_label, r.score, r.classification) for r in got] == [("t", 6.0, "Atenção")]
    assert runs.load_run([empty], "q").count() == 0
    # a later table counts only where the earlier ones have no row; a column of two types is text
    first = spark.createDataFrame([("r", "a", 1.0, 7)], "run_id string, dataset_label string, score double, extra int")
    third = spark.createDataFrame([("r", "b", 2.0, "x"), ("s", "b", 3.0, "y")], "run_id string, dataset_label string, score double, extra string")
    assert [(r.dataset_label, r.extra) for r in runs.load_run([empty, first, third], "r").collect()] == [("a", "7")]
    assert [(r.dataset_label, r.score) for r in runs.load_run([empty, first, third], "s").collect()] == [("b", 3.0)]


def test_load_run_plans_without_a_job(spark):
    spark.sparkContext.setJobGroup("load_run", "plan only")
    try:
        runs.load_run([scores(spark, []), scores(spark, [])], "r")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("load_run")


def test_best_label_default(spark):
    df = spark.createDataFrame([(None, "")], "dataset string, source string")
    assert df.select(runs.best_label(df)).first()[0] == C.LABEL_DEFAULT


def test_running_index(spark):
    df = spark.range(0, 5000, 1, 7).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k")).orderBy(F.rand(1))
    got = rankings.with_running_index(df, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 5001))


def test_review_fallback(spark):
    detail = spark.createDataFrame([], "dataset_label string, column_name string, score double")
    assert [tuple(r) for r in recommend.review_recommendations(detail, "r").collect()] == [
        ("r", "Média", "", C.REVIEW_EMPTY)]
    one = spark.createDataFrame([("d", "c", 1.0)], detail.schema)
    assert [tuple(r) for r in recommend.review_recommendations(one, "r").collect()] == [
        ("r", "Alta", "d", "Revisar a coluna c do dataset d.")]


def test_defaults_for_absent_columns(spark):
    r = recommend.with_theme(spark.createDataFrame([(" nulos ",), (None,)], "recomendacao string")).collect()
    assert {(x.run_id, x.prioridade, x.dataset_label, x.recomendacao, x.tema) for x in r} == {
        ("", C.PRIORITY_UNSET, C.DATASET_UNSET, "nulos", "Completude"),
        ("", C.PRIORITY_UNSET, C.DATASET_UNSET, "", "Qualidade Geral")}


def test_rec_counts_largest(spark):
    df = spark.createDataFrame([(k,) for k in "aaabbc"], "k string")
    assert [tuple(r) for r in recommend.rec_counts(df, "k", 2).collect()] == [("b", 2), ("a", 3)]


def test_lowest_dimension_ties(spark):
    df = spark.createDataFrame([(5.0, 5.0, 9.0, 9.0, 9.0, 9.0), (9.0, 9.0, 9.0, 9.0, 9.0, 0.0)],
                               ", ".join(f"{d} double" for d in C.DIMENSIONS))
    got = [r.lowest_dimension for r in recommend.lowest_dimension_advice(df).collect()]
    assert got == ["Completude", "Atualidade"]


def test_metric_report_of_named_object(spark):
    cols = list(C.METRIC_MEANINGS)
    df = spark.createDataFrame([("r", "a", *[9.0] * 6), ("r", "b", 9.5, None, 8.0, 7.0, 0.25, 0.5)],
                               "run_id string, object_name string, " + ", ".join(f"{c} double" for c in cols))
    best = {r.metrica: r.valor for r in rankings.metric_report(df).collect()}
    assert best["score_final"] == "9.5" and best["score_completeness"] == "-"
    assert {r.valor for r in rankings.metric_report(df, "a", "r").collect()} == {"9"}


def test_history_tables(spark):
    s = spark.createDataFrame(
        [("r", AT, "d", "file", 4.0, "Crítico", 3, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)],
        "run_id string, scanned_at timestamp_ntz, dataset_label string, source_type string, score double, "
        "classification string, column_count bigint, " + ", ".join(f"{d} double" for d in C.DIMENSIONS))
    detail = spark.createDataFrame([("r", AT, "d", "c1", 1.0, "Crítico"), ("r", AT, "d", "c2", 9.0, "Excelente")],
                                   "run_id string, scanned_at timestamp_ntz, dataset_label string, column_name string, "
                                   "score double, classification string")
    h = history.dataset_history(s, detail).first()
    assert (h.critical_columns_count, h.priority_index) == (1, 9.0)
    assert history.run_history(s).first().overall_classification == "Crítico"
    assert history.dimension_history(s).count() == 6
    recs = {r.recommendation_level: r for r in history.recommendation_history(s, detail).collect()}
    assert recs["dataset"].recommendation_type == "Completude" and recs["dataset"].priority_score == 17.0
    assert recs["column"].priority_band == "Imediata" and recs["column"].owner_suggestion is None
    assert recommend and history.recommendation_view(history.recommendation_history(s, detail)).count() == 2
