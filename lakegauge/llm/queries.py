"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegauge.llm import contamination, interaction, jaccard, language, lines, maxent, negatives, packing, pieces, quality, secrets, simhash, substring
from lakegauge.llm.common import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), ["doc_id"])

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = joined(F.filter("spans", lambda s: s["kind"] != "random"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))
    return quality.scored(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0), model, ["doc_id", "held_out"])


@query("op3_substring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(documents(spark, sf_dir))


@query("op4_maxent")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder(F.col("doc_id"), 5) == 1)
    return maxent.scored(docs, ~F.col("held_out"), ["doc_id", "held_out"])


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = language.profiles(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return language.identify(docs.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2), known,
                             ["doc_id", "held_out"])


@query("op6_lines", lines.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judged(documents(spark, sf_dir))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(packing.pieces(documents(spark, sf_dir), ["doc_id"]))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op8_pieces")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir), ["doc_id"])


@query("op9_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(documents(spark, sf_dir), width=4, percent=85)


@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.report(documents(spark, sf_dir))
    # search: each document whose id is divisible by 20, against all; n_near counts the documents within 3 bits, itself too
    counts = rows.groupBy("fingerprint").agg(F.count("*").alias("n")).withColumn("mark", simhash.as_number(F.col("fingerprint")))
    asks = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    asked = rows.where(asks).withColumn("mark", simhash.as_number(F.col("fingerprint")))
    near = simhash.within(asked.select("mark"), counts.select("mark")).join(counts.withColumnRenamed("mark", "found"), "found") \
        .groupBy("query").agg(F.sum("n").alias("n_near"))
    searched = asked.join(near, F.col("mark") == F.col("query"), "left").select(*rows.columns, "n_near")
    return searched.unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("bigint")))


@query("op11_interaction", interaction.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(interaction.masks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op12_negatives", negatives.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # labels that are wrong on purpose: a seventh of the rows take the next one
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query("op13_contamination", contamination.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
