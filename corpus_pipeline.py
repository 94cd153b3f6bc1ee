"""A corpus pipeline over documents: each stage applies one operator of lakegauge.llm to what its predecessor kept."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakegauge.llm import jaccard, language, packing, secrets, substring
from lakegauge.llm.common import bloom, in_bloom, settled
from lakegauge.session import work_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# the nearest language must lie this near: prose of a known language scores 0.4 and more, however short
MIN_LANGUAGE_SCORE = 0.3
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with at most about BATCH_BYTES handed to Python at a time: a batch of texts stands in memory on both sides.

    The setting stays, because the stage's rows are computed when its caller writes them.
    """
    @wraps(stage)
    def planned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return planned


@in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without a letter or far from every profile go."""
    known = language.profiles(docs)
    judged = language.identify(docs.select(*COLUMNS), known, list(COLUMNS))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more on five-word shingles connect: that with the least id.

    Rows with one id are told apart by their texts; of equal rows one stays. Null ids come last. Texts that neither link
    nor repeat are kept where they are read: only those that a filter over the keys of the others lets pass are shuffled.
    """
    # hex digits that sort as the ids do, then the text
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat_ws(":", F.coalesce(number, F.lit("~")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    keyed = docs.select(*COLUMNS).withColumn("key", key).withColumn("hash", F.xxhash64("key"))

    def judged() -> DataFrame:
        found = jaccard.linked(keyed.select("key", "text"), id="key", width=5, percent=80)
        groups = found.groupBy("key").agg(F.count("*").alias("n"), F.min("component_id").alias("first"))
        return groups.where((F.col("n") > 1) | (F.col("key") != F.col("first"))) \
            .select("key", (F.col("key") == F.col("first")).alias("stays"), F.xxhash64("key").alias("hash"))

    doubtful = settled(spark, "doubtful", judged)
    bits = spark.sparkContext.broadcast(bloom(doubtful, "hash"))

    def passing(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(in_bloom(bits.value, b.column(len(b.schema) - 1).to_numpy().view("uint64")) == wanted))
        return keyed.mapInArrow(run, keyed.schema)

    once = passing(True).groupBy("key").agg(*[F.first(c).alias(c) for c in COLUMNS])
    kept = once.join(doubtful.select("key", "stays"), "key", "left").where(F.coalesce("stays", F.lit(True)))
    return passing(False).select(*COLUMNS).unionByName(kept.select(*COLUMNS))


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


@in_small_batches
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows of 35 repeat; a document of which no word is left goes."""
    left = substring.without_repeats(docs.select(*COLUMNS))
    return counted(left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


@in_small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    return counted(secrets.redacted(docs.select(*COLUMNS)))


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    rows = packing.packed(packing.pieces(docs, ["doc_id"]))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("secrets", without_secrets),
    ("packing", packed),
]

# languages, test batteries and packing are no SQL: tests/llm holds the stages against brute-force versions
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    before = spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            made = stage(spark, docs, sf_dir)
            path = work_path(spark, f"stage-{name}")
            made.write.parquet(path)
            docs = spark.read.schema(made.schema).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return docs
