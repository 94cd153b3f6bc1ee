"""KPIs, rankings, history and the points and texts of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from lakegauge import constants as C
from lakegauge.functions import scoring
from lakegauge.operators.runs import class_value, score_column, score_value
from lakegauge.session import work_path

ATTENTION_COLUMNS = ("dataset_label", "column_name", "dtype", "score", "classification",
                     "null_rate", "distinct_ratio", "violations")


def kpis(scores: DataFrame, *keys: str, label: str = "dataset_label") -> DataFrame:
    """Number of datasets, mean, best and worst, and how many fall into which class.

    One aggregate; ties are settled by name, an empty input gives zeros and fixed texts.
    """
    s, k = score_value(scores), class_value(scores)
    best = F.min_by(F.struct(F.col(label), s.alias("s")), F.struct((-s).alias("s"), F.col(label)))
    worst = F.min_by(F.struct(F.col(label), s.alias("s")), F.struct(s.alias("s"), F.col(label)))
    agg = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("datasets"), scoring.exact_round(F.avg(s), 2).alias("mean"), best.alias("b"), worst.alias("w"),
        F.count_if(k == "Crítico").alias("criticos"), F.count_if(k == "Atenção").alias("atencao"),
        F.count_if(k.isin("Bom", "Excelente")).alias("aceitaveis"))
    zero = F.lit(0.0)
    return agg.select(
        *keys, "datasets", F.coalesce("mean", zero).alias("score_medio"),
        scoring.classify(F.col("mean"), "report").alias("classificacao"),
        F.coalesce(F.col(f"b.{label}"), F.lit(C.NO_DATA)).alias("melhor_dataset"),
        F.coalesce(scoring.exact_round(F.col("b.s"), 2), zero).alias("melhor_score"),
        F.coalesce(F.col(f"w.{label}"), F.lit(C.NO_DATA)).alias("pior_dataset"),
        F.coalesce(scoring.exact_round(F.col("w.s"), 2), zero).alias("pior_score"),
        "criticos", "atencao", "aceitaveis")


def summary_text(kpi: DataFrame) -> DataFrame:
    return kpi.withColumn("resumo", F.format_string(
        C.SUMMARY_TEXT, "datasets", "score_medio", "classificacao", "criticos", "atencao"))


def top_n(df: DataFrame, n: int, *ties: str, ascending: bool = False, score: str = "score") -> DataFrame:
    """The n best (or worst) rows; only n rows per task and the final n leave the sort."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    return df.orderBy(order, *[F.col(t).asc() for t in ties]).limit(n)


def top_datasets(scores: DataFrame, n: int = 5, ascending: bool = False) -> DataFrame:
    work = scores.select("dataset_label", score_value(scores).alias("score"), class_value(scores).alias("classification"))
    return top_n(work, n, "dataset_label", ascending=ascending)


def attention(detail: DataFrame, n: int = 20) -> DataFrame:
    """The n lowest-scoring columns, with those of the report fields that exist."""
    work = detail.withColumn("score", score_value(detail)).withColumn("classification", class_value(detail))
    kept = [c for c in ATTENTION_COLUMNS if c in work.columns]
    return top_n(work.select(*kept), n, "dataset_label", "column_name", ascending=True)


def ranked(scores: DataFrame, *ties: str) -> DataFrame:
    name = score_column(scores) or "score"
    return scores.orderBy(F.col(name).desc(), *[F.col(t).asc() for t in ties])


def history(scores: DataFrame, by: str = "run_id", name: str = "avg_score") -> DataFrame:
    return scores.groupBy(by).agg(F.avg(score_value(scores)).alias(name)).orderBy(by)


def metric_report(scores: DataFrame, object_name: str | None = None, run_id: str | None = None) -> DataFrame:
    """Six metrics of one dataset (the best one unless named) with text value and meaning."""
    rows = scores
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    if object_name is not None:
        rows = rows.where(F.col("object_name") == object_name)
    metrics = list(C.METRIC_MEANINGS)
    one = top_n(rows, 1, "object_name", score="score_final")
    return (one.select("object_name", *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot("object_name", metrics, "metrica", "v")
            .select("object_name", "metrica", scoring.fmt_score(F.col("v")).alias("valor"),
                    scoring.lookup(F.col("metrica"), C.METRIC_MEANINGS).alias("significado")))


def with_running_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers the rows 1..n in the given order without a one-task window.

    Rows are range-partitioned, written once to the shared folder (so that a lost
    task cannot reshuffle them), numbered inside their partition, and shifted by
    the sizes of the partitions before.
    """
    spark = df.sparkSession
    path = work_path(spark, "index")
    spread = [F.col(c) for c in order] + [F.xxhash64(*df.columns)]
    (df.repartitionByRange(*spread).withColumn("_part", F.spark_partition_id())
     .write.partitionBy("_part").parquet(path))
    rows = spark.read.schema(
        T.StructType(df.schema.fields + [T.StructField("_part", T.IntegerType())])).parquet(path)
    # the unpartitioned window below sees one row per shuffle partition, not the data
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (rows.withColumn("_n", within).join(F.broadcast(shifts), "_part")
            .withColumn(name, F.col("_n") + F.col("_shift")).drop("_part", "_n", "_shift"))


def score_matrix(scores: DataFrame) -> DataFrame:
    """Volume and score per dataset; without a volume the datasets are numbered by name."""
    work = scores.withColumn("score", score_value(scores))
    if "row_count" not in scores.columns:
        work = with_running_index(work, ["run_id", "dataset_label"], "row_count")
    volume = F.coalesce(F.col("row_count").cast("double"), F.lit(0.0))
    return work.select("run_id", "dataset_label", volume.alias("row_count"), "score")


def radar_status(long: DataFrame, *keys: str) -> DataFrame:
    """Mean over the dimensions and its status."""
    return long.groupBy(*keys).agg(F.avg("score").alias("media")).withColumn(
        "status", scoring.classify(F.col("media"), "radar"))
