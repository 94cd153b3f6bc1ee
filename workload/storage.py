"""Sources, sinks, change detection and whole runs, each read back and compared."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F, types as T

from lakegauge import constants as C, schemas
from lakegauge.functions import cells
from lakegauge.operators.profile import PROFILE
from lakegauge.plans import batch, scan
from lakegauge.session import work_path
from lakegauge.sources import csv, inbox, sinks
from lakegauge.sources import datasets as ds
from lakegauge.streaming import inbox as stream
from workload.checks import ORDERS_AS_OF, SUITE, VERDICTS, joined_text, rates_sql
from workload.profiles import DATASETS, FULL, TABLES as COLUMNS, column_sql, profile_sql
from workload.registry import load, query, rounded
from workload.scores import _T
from workload.tables import SCAN_NOTE, STAR_NOTE, bands, clamp, cte, orders_dirty

AT = datetime(2024, 3, 1, 8, 0)
TABLES = ("benchmark conversations customer documents embeddings events labels lineitem nation orders pages part "
          "region supplier").split()
_CSV_COLUMNS = ("o_orderkey", "customer_id", "vl_total", "status", "email", "valor_txt", "data_txt")


@query("csv_scan", cte(
    f"SELECT sep, {', '.join(_CSV_COLUMNS[:3])}, status, CASE WHEN trim(email) = '' THEN NULL ELSE email END AS email, "
    "valor_txt, CASE WHEN data_txt = 'n/a' THEN NULL ELSE data_txt END AS data_txt "
    "FROM orders_dirty, (VALUES (','), (';')) AS s(sep)", "orders_dirty"))
def csv_scan(spark, sf_dir):
    """Orders written as CSV with either separator and read back with guessed separator and types."""
    df = orders_dirty(spark, sf_dir).select(*_CSV_COLUMNS)
    out = None
    for sep in (",", ";"):
        path = work_path(spark, "csv")
        if sep == ",":
            csv.export_csv(df, path)
        else:
            df.write.option("header", True).option("sep", sep).option("emptyValue", "").csv(path)
        found = csv.scan_csv(spark, path, "auto").df.withColumn("sep", F.lit(sep))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("email", F.when(F.trim("email") != "", F.col("email")))


@query("parquet_scan", """
    SELECT 'lineitem.parquet' AS label, l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY ALL""")
def parquet_scan(spark, sf_dir):
    d = ds.scan_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return rounded(d.df.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).withColumn("label", F.lit(d.label)), 2)


@query("catalog_scan", "SELECT 'gauge_customers' AS label, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def catalog_scan(spark, sf_dir):
    load(spark, sf_dir, "customer").createOrReplaceTempView("gauge_customers")
    d = ds.scan_table(spark, "gauge_customers")
    return d.df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(d.label))


@query("capped_scan", """
    SELECT count(*) AS sample_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, sum(o_orderkey)::BIGINT AS keys,
      round(sum(o_totalprice), 2) AS price FROM (SELECT * FROM orders LIMIT 5000)""")
def capped_scan(spark, sf_dir):
    """The row cap of a scan as a feature: the first rows of the file, the same ones in two aggregates of the same table."""
    df = ds.scan_parquet(spark, f"{sf_dir}/orders.parquet", limit=5000).df
    keys = df.agg(F.count(F.lit(1)).alias("sample_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"),
                  F.sum("o_orderkey").alias("keys"))
    price = df.repartition(5).agg(F.sum("o_totalprice").alias("price"))
    # two single rows side by side
    return rounded(keys.withColumn("k", F.lit(1)).join(price.withColumn("k", F.lit(1)), "k").drop("k"), 2)


@query("hash_sample", """
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 5000""")
def hash_sample(spark, sf_dir):
    return ds.sample_rows(load(spark, sf_dir, "orders"), 5000, "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderstatus")


@query("envelope", cte(
    """SELECT 'run_a' AS run_id, TIMESTAMP '2024-03-01 08:00:00' AS scanned_at, 'file' AS source_type, 'file' AS source,
      'orders.parquet' AS source_name, 'ref' AS source_ref, 'orders' AS object_name, 'orders' AS dataset_name,
      'orders' AS dataset, '' AS table_name, 'orders.parquet' AS file_name, '' AS sheet_name, status, count(*) AS n
    FROM orders_dirty GROUP BY status""", "orders_dirty"))
def envelope(spark, sf_dir):
    """Blank object and dataset names fall back to the label."""
    meta = {**ds.file_meta("/data/orders.parquet"), "object_name": "  ", "dataset_name": "", "source_ref": "ref"}
    counts = orders_dirty(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return ds.with_envelope(counts, ds.Dataset("orders", counts, meta), "run_a", AT)


@query("schema_align", """
    SELECT NULL::VARCHAR AS run_id, o_orderkey::VARCHAR AS dataset_name, NULL::TIMESTAMP AS run_timestamp,
      o_orderstatus AS dimension_name, o_totalprice AS dimension_score FROM orders""")
def schema_align(spark, sf_dir):
    df = load(spark, sf_dir, "orders").select(
        F.col("o_totalprice").alias("dimension_score"), F.col("o_orderkey").alias("dataset_name"), "o_custkey",
        F.col("o_orderstatus").alias("dimension_name"))
    return schemas.align(df, schemas.DIMENSION_HISTORY)


# --- sinks --------------------------------------------------------------------------------

@query("rerun_idempotent", """
    SELECT concat('run_', year(o_orderdate)::VARCHAR) AS run_id, o_orderstatus, count(*) AS n,
      CASE WHEN year(o_orderdate) = 1998 THEN 'second' ELSE 'first' END AS attempt FROM orders GROUP BY ALL""")
def rerun_idempotent(spark, sf_dir):
    """Every year is written as a run, then one run again: only its rows are replaced."""
    path = work_path(spark, "runs")
    counts = load(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("run_"), F.year("o_orderdate").cast("string")).alias("run_id"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"))
    sinks.write_run(counts.withColumn("attempt", F.lit("first")), path)
    again = counts.where(F.col("run_id") == "run_1998").withColumn("attempt", F.lit("second"))
    for _ in range(2):
        sinks.write_run(again, path)
    return spark.read.parquet(path).select("run_id", "o_orderstatus", "n", "attempt")


@query("rerun_one_object", """
    SELECT concat('run_', year(o_orderdate)::VARCHAR) AS run_id, o_orderstatus AS object_name, count(*) AS n,
      CASE WHEN year(o_orderdate) = 1998 AND o_orderstatus = 'F' THEN 'second' ELSE 'first' END AS attempt
    FROM orders GROUP BY ALL""")
def rerun_one_object(spark, sf_dir):
    """The same for one object of one run."""
    path, keys = work_path(spark, "runs"), ("run_id", "object_name")
    counts = load(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("run_"), F.year("o_orderdate").cast("string")).alias("run_id"),
        F.col("o_orderstatus").alias("object_name")).agg(F.count(F.lit(1)).alias("n"))
    sinks.write_run(counts.withColumn("attempt", F.lit("first")), path, keys)
    one = counts.where((F.col("run_id") == "run_1998") & (F.col("object_name") == "F"))
    sinks.write_run(one.withColumn("attempt", F.lit("second")), path, keys)
    return spark.read.parquet(path).select("run_id", "object_name", "n", "attempt")


@query("run_log_append", """
    SELECT TIMESTAMP '2024-03-01 08:00:00' AS run_ts, 'day' || l_linenumber AS source_file,
      CASE WHEN l_linenumber < 4 THEN NULL ELSE 'h' END AS file_hash, 'stg.src' AS table_name,
      count(*) AS total_registros, NULL::DOUBLE AS nota_final FROM lineitem GROUP BY ALL""")
def run_log_append(spark, sf_dir):
    """A log whose older rows lack the hash column grows without losing them."""
    path = work_path(spark, "log")
    rows = load(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("total_registros")) \
        .withColumns({"run_ts": cells.moment(AT), "table_name": F.lit("stg.src"),
                      "source_file": F.concat(F.lit("day"), F.col("l_linenumber").cast("string"))})
    older = T.StructType([f for f in schemas.RUN_LOG.fields if f.name != "file_hash"])
    schemas.align(rows.where(F.col("l_linenumber") < 4), older).write.parquet(path)
    sinks.append_run_log(rows.where(F.col("l_linenumber") >= 4).withColumn("file_hash", F.lit("h")), path, schemas.RUN_LOG)
    return sinks.read_runs(spark, path, schemas.RUN_LOG).select(
        "run_ts", "source_file", "file_hash", "table_name", "total_registros", "nota_final")


@query("staged_table", """
    SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 1) AS appended FROM orders
    WHERE o_orderkey % 3 <> 0 GROUP BY o_orderstatus""")
def staged_table(spark, sf_dir):
    """A staging table is written, replaced and appended to: two thirds of the orders, the first third replaced."""
    name = f"staged_{uuid.uuid4().hex}"
    orders = load(spark, sf_dir, "orders")
    sinks.write_table(orders.where("o_orderkey % 3 = 0"), name)
    sinks.write_table(orders.where("o_orderkey % 3 = 2"), name, "replace")
    sinks.write_table(orders.where("o_orderkey % 3 = 1"), name, "append")
    return spark.table(name).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 3 == 1).alias("appended"))


# --- inbox --------------------------------------------------------------------------------

_COUNTS = {t: f"SELECT '{t}.parquet' AS source_file, count(*) AS n FROM {t}" for t in TABLES}


@query("inbox_datasets", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS label, 'file' AS source_type, count(*) AS n FROM {t}" for t in TABLES))
def inbox_datasets(spark, sf_dir):
    found, _ = inbox.scan_inbox(spark, sf_dir, ["*.PARQUET", ".csv"])
    counts = [d.df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(d.label).alias("label"), F.lit(d.meta["source_type"]).alias("source_type"), "n") for d in found]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


def _changed(mode: str) -> str:
    due = [t for t in TABLES if mode != "skip" or t not in ("lineitem", "documents")]
    return " UNION ALL ".join(f"SELECT '{mode}' AS mode, * FROM ({_COUNTS[t]})" for t in due)


def _reordered(spark, sf_dir):
    """Order keys as four text files, written again in the same order and in another: lines of the files that are due."""
    keys = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("part")).repartition(4, "part")

    def written(order):
        path = work_path(spark, "lines")
        keys.sortWithinPartitions(order).select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
        return inbox.file_hashes(spark, path, ["txt"]).withColumn("source_file", F.regexp_extract("source_file", r"part-(\d+)", 1))

    log = written(F.asc("o_orderkey")).select("source_file", "file_hash")
    out = None
    for mode, order in (("unchanged", F.asc("o_orderkey")), ("reordered", F.desc("o_orderkey"))):
        due = [r.path for r in inbox.changed_files(written(order), log).select("path").collect()]
        lines = spark.read.text(due) if due else spark.createDataFrame([], "value string")
        part = lines.agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), F.lit("orders").alias("source_file"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("changed_files", " UNION ALL ".join(_changed(m) for m in ("skip", "append", "replace"))
       + " UNION ALL SELECT 'unchanged', 'orders', 0 UNION ALL SELECT 'reordered', 'orders', count(*) FROM orders")
def changed_files(spark, sf_dir):
    """Two files are in the log with their present hash, one with an older one; what is due gets counted. Files that are
    written again are due if their lines come in another order."""
    hashes = inbox.file_hashes(spark, sf_dir, ["parquet"])
    name = F.col("source_file")
    log = hashes.where(name.isin("lineitem.parquet", "documents.parquet", "orders.parquet")).withColumn(
        "file_hash", F.when(name == "orders.parquet", "older").otherwise(F.col("file_hash")))
    out = None
    for mode in ("skip", "append", "replace"):
        for f in inbox.changed_files(hashes, log, mode).orderBy("source_file").collect():
            part = inbox.read_file(spark, f.path, f.ext).df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(mode).alias("mode"), F.lit(f.source_file).alias("source_file"), "n")
            out = part if out is None else out.unionAll(part)
    return out.unionAll(_reordered(spark, sf_dir))


def _judged_sql(t: str) -> str:
    """The log row of a table: heuristic dimensions and note."""
    names = [c for c, _ in COLUMNS[t]]
    return f"""
      SELECT 'stg.src_{t}' AS table_name, '{t}.parquet' AS source_file, (SELECT count(*) FROM {t}) AS n,
        round({clamp('10 * avg(present / total)')}, 2) AS completude,
        round(10 * (SELECT count(DISTINCT {joined_text(names)}) / count(*) FROM {t}), 2) AS unicidade,
        round({clamp('10 * coalesce(sum(vsum) / nullif(sum(vparts), 0), 1)')}, 2) AS validade,
        round({clamp('10 * avg(greatest(chosen, 1 - chosen))')}, 2) AS consistencia,
        round({clamp('10 * coalesce(avg(integrity), 1)')}, 2) AS integridade,
        round({clamp("coalesce(10 * (1 - (epoch(TIMESTAMP '2001-12-10 12:00:00') - epoch(arg_max(latest, "
                     "CASE WHEN date_share >= 0.7 THEN date_share * 1000 - ordinal END))) / 3600 / 24), 0)")}, 2) AS freshness
      FROM verdicts WHERE dataset = '{t}'"""


@query("inbox_batch", cte(
    f"SELECT *, round({STAR_NOTE}, 2) AS nota_final FROM notes",
    rates=" UNION ALL ".join(rates_sql(t, c, k, i) for t in COLUMNS for i, (c, k) in enumerate(COLUMNS[t])),
    verdicts=VERDICTS, notes=" UNION ALL ".join(_judged_sql(t) for t in COLUMNS)))
def inbox_batch(spark, sf_dir):
    """Heuristic batch over the folder, twice: the second run finds nothing changed. All dimensions of every table."""
    log = work_path(spark, "log")
    for run_ts in (AT, datetime(2024, 3, 2, 8, 0)):
        latest = batch.run_inbox(spark, sf_dir, log, run_ts, ORDERS_AS_OF)
    return latest.where(F.col("run_ts") == cells.moment(AT)).select(
        "table_name", "source_file", F.col("total_registros").alias("n"), *C.DIMENSIONS, "nota_final")


def _profile_sql(t: str) -> str:
    parts = []
    for i, (c, k) in enumerate(COLUMNS[t]):
        if k.startswith("array"):
            parts.append(f"SELECT '{t}' AS dataset, '{c}' AS column_name, count(*) AS total, count(*) - count({c}) AS nulls, "
                         f"count(DISTINCT {c}) AS distinct_cnt, NULL::VARCHAR AS min_value, NULL::VARCHAR AS max_value, NULL::BIGINT AS max_len FROM {t}")
        else:
            parts.append(f"SELECT dataset, column_name, total, nulls, distinct_cnt, min_value, max_value, max_len FROM ({column_sql(t, i, c, k)})")
    return " UNION ALL ".join(parts)


@query("inbox_incremental", cte(
    "SELECT dataset || '.parquet' AS dataset_name, * EXCLUDE (dataset) FROM found", found=" UNION ALL ".join(_profile_sql(t) for t in COLUMNS)))
def inbox_incremental(spark, sf_dir):
    """The folder as a stream of files, started twice: the profile of every column; the second start finds nothing new."""
    out, checkpoint = work_path(spark, "profiles"), work_path(spark, "progress")
    for _ in range(2):
        stream.scan_new_files(spark, sf_dir, out, checkpoint, "inc", AT, files_per_batch=5)
    found = spark.read.schema(schemas.COLUMN_METRICS).parquet(out)
    return found.select("dataset_name", "column_name", "total", "nulls", "distinct_cnt", "min_value", "max_value",
                        F.when(~F.col("dtype").startswith("array"), F.col("max_len")).alias("max_len"))


@query("growing_table", profile_sql(f"SELECT {FULL} FROM p", ("lineitem",)))
def growing_table(spark, sf_dir):
    """A table that grows between two starts of its stream: the profile of all its rows, though each is read once."""
    line = load(spark, sf_dir, "lineitem")
    box, out, mark, state = (work_path(spark, n) for n in ("table", "profiles", "progress", "state"))
    for half in (0, 1):
        line.where(F.col("l_orderkey") % 2 == half).write.mode("append").parquet(box)
        stream.scan_growing_table(spark, box, line.schema, out, mark, state, "lineitem", "inc", AT)
    last = spark.read.schema(stream.PROFILE_RUNS).parquet(out).where(F.col("run_id") == "inc_000001")
    return rounded(last.select("dataset", *PROFILE.fieldNames())).drop("type_count")


# --- a whole run ------------------------------------------------------------------------------

_NAMES = ("orders_dirty", "lineitem", "events")


@query("scan_run", profile_sql(
    f"""SELECT dataset AS dataset_name, row_count, column_count, completude, unicidade, consistencia, validade,
      integridade, freshness, score, {bands('score')} AS classification,
      CASE WHEN dataset = 'orders_dirty' THEN 11 ELSE 0 END::BIGINT AS rules
    FROM (SELECT *, round({SCAN_NOTE}, 4) AS score FROM t)""", _NAMES, **_T))
def scan_run(spark, sf_dir):
    """Sources to written result tables, read back: table scores beside the number of rule results."""
    found = [ds.Dataset(n, orders_dirty(spark, sf_dir) if n == "orders_dirty" else load(spark, sf_dir, n),
                        {"source_type": "file", "dataset_name": n}) for n in _NAMES]
    paths = scan.run_scan(found, SUITE, ds.run_id_of(AT), AT, work_path(spark, "scan"), batch=2)
    rules = spark.read.schema(schemas.RULE_RESULTS).parquet(paths["rule_results"]).groupBy("dataset_name").agg(F.count(F.lit(1)).alias("rules"))
    return spark.read.schema(schemas.TABLE_SCORES).parquet(paths["table_scores"]).join(rules, "dataset_name", "left").select(
        "dataset_name", "row_count", "column_count", *C.DIMENSIONS, "score", "classification",
        F.coalesce("rules", F.lit(0)).alias("rules"))
