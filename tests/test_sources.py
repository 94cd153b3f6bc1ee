"""CSV, inbox, change detection, databases, sinks, streams and whole runs on small files."""

import hashlib
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from lakegauge import schemas, session
from lakegauge.plans import batch, scan
from lakegauge.sources import csv, digest, inbox, jdbc, sinks
from lakegauge.sources import datasets as ds
from lakegauge.streaming import inbox as stream

AT = datetime(2024, 3, 1, 8, 0)


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(str(folder), name)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def test_csv_types_and_missing(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'i,d,b,s,n,x\n1,1.5,true,"a ""q"", b",NA,1d\n2,null,FALSE,,,2\n,2,,NaN,n/a,3\n')
    d = csv.scan_csv(spark, path)
    assert dict(d.df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "n": "double", "x": "string"}
    assert [tuple(r) for r in d.df.collect()] == [
        (1, 1.5, True, 'a "q", b', None, "1d"), (2, None, False, None, None, "2"), (None, 2.0, None, None, None, "3")]
    assert d.label == "a.csv" and d.meta["source_type"] == "file"


def test_csv_separator_encoding_schema_cap(spark, tmp_path):
    path = put(tmp_path, "b.csv", "nome;v\nação;1\nb;2\n", "latin-1")
    d = csv.scan_csv(spark, path, "auto", "ISO-8859-1")
    assert [tuple(r) for r in d.df.collect()] == [("ação", 1), ("b", 2)]
    typed = csv.scan_csv(spark, path, ";", "ISO-8859-1", schema=T.StructType([T.StructField("v", T.IntegerType())]))
    assert typed.df.dtypes == [("v", "int")]
    assert csv.scan_csv(spark, path, ";", "ISO-8859-1", limit=1).df.count() == 1


@pytest.mark.parametrize("limit,first", [(1, 1), (30, 30), (31, 31), (64, 64), (65, 65), (5000, 200)])
def test_a_cap_is_the_same_rows_everywhere(spark, tmp_path, limit, first):
    """The head by file and place: every aggregate, and every way to repartition, sees one set of rows."""
    path = str(tmp_path / "a b%20ü.parquet")
    spark.range(200).withColumn("p", (F.col("id") / 64).cast("int")).repartitionByRange(7, "id").sortWithinPartitions(F.desc("id")) \
        .write.partitionBy("p").parquet(path)
    rows = [r.id for r in spark.read.parquet(path).select("id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    df = ds.scan_parquet(spark, path, limit).df
    assert df.columns == ["id", "p"] and sorted(r.id for r in df.collect()) == sorted(rows[:limit]) and df.count() == first
    for n in (1, 3, 11):
        assert {r.id for r in df.repartition(n).collect()} == set(rows[:limit])
    got = df.agg(F.sum("id").alias("s"), F.max("p").alias("p")).first()
    assert got.s == sum(rows[:limit])


def test_a_cap_opens_only_the_first_files(spark, tmp_path):
    for i in range(12):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "t" / f"part={i:02d}"))
    df = ds.scan_parquet(spark, str(tmp_path / "t"), 15).df
    assert sorted(r.id for r in df.collect()) == list(range(15))
    scan = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert len(scan) == 1
    for f in (tmp_path / "t" / "part=07").iterdir():
        if f.name.endswith(".parquet"):
            f.write_bytes(b"broken")  # behind the cap, so nobody notices
    assert ds.head(spark.read.schema("id long, part int").parquet(str(tmp_path / "t")), 15).count() == 15


def test_a_capped_view_is_a_copy(spark):
    spark.range(100).repartition(7).createOrReplaceTempView("gauge_view")
    df = ds.scan_table(spark, "gauge_view", 10).df
    once = sorted(r.id for r in df.collect())
    assert len(once) == 10 and all(sorted(r.id for r in df.repartition(n).collect()) == once for n in (1, 5))


def test_csv_line_breaks(spark, tmp_path):
    path = put(tmp_path, "c.csv", 'a,b\n"x\ny",1\n')
    assert [tuple(r) for r in csv.scan_csv(spark, path, multiline=True).df.collect()] == [("x\ny", 1)]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ('q"', 1)], "s string, n int")
    csv.export_csv(df, str(tmp_path / "out"))
    back = csv.scan_csv(spark, str(tmp_path / "out")).df
    assert {tuple(r) for r in back.collect()} == {("a,b", None), ('q"', 1)}


def test_inbox_listing(spark, tmp_path):
    put(tmp_path, "b.csv", "a\n1\n")
    put(tmp_path, "a.CSV", "a\n1\n2\n")
    put(tmp_path, "c.txt", "x")
    os.mkdir(tmp_path / "sub")
    put(tmp_path / "sub", "d.csv", "a\n1\n")
    found, errors = inbox.scan_inbox(spark, str(tmp_path))
    assert [d.label for d in found] == ["a.CSV", "b.csv"] and errors == [("c.txt", "unsupported extension: txt")]
    found, errors = inbox.scan_inbox(spark, str(tmp_path), ["*.CSV", ".csv"])
    assert [d.df.count() for d in found] == [2, 1] and errors == []
    assert inbox.normalized_extensions([" *.Parquet", ".csv", "xls", "", None]) == {"parquet", "csv", "xls"}


def test_many_files_are_read_by_a_few_jobs(spark, tmp_path):
    """Files of a few widths: the same datasets as one by one, and no more jobs for a hundred files than for seventy."""
    def fill(n):
        box = tmp_path / f"in{n}"
        os.mkdir(box)
        for i in range(n):
            put(box, f"a {i}+ü%.csv", f'id,Name,name\n{i},"x, ""y""",{i}.5\n,null,\n')
            put(box, f"b{i}.csv", f"k,v\n{'1' if i % 2 else 'true'},2024\n")
        put(box, "empty.csv", "p,q\n")
        put(box, "wide.csv", "a,b\n1,2\n3,4,5\n")
        put(box, "bad.parquet", "x")
        return str(box)

    def jobs(folder):
        spark.sparkContext.setJobGroup(folder, "count")
        try:
            found, errors = inbox.scan_inbox(spark, folder)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, errors, len(spark.sparkContext.statusTracker().getJobIdsForGroup(folder))

    four, few = fill(4), None
    for folder in (fill(35), fill(50)):
        found, errors, n = jobs(folder)
        few = few or n
        assert n <= few + 1, "jobs grow with files"
        assert [e[0] for e in errors] == ["bad.parquet", "wide.csv"] and errors[1][1] == "1 rows have more than 2 fields"
    one = {d.label: csv.scan_csv(spark, os.path.join(four, d.label)) for d in inbox.scan_inbox(spark, four, ["csv"])[0]}
    for d in inbox.scan_inbox(spark, four, ["csv"])[0]:
        assert d.df.dtypes == one[d.label].df.dtypes and d.df.collect() == one[d.label].df.collect(), d.label
        assert {**d.meta, "source_ref": ""} == {**one[d.label].meta, "source_ref": ""}
    assert len(one) == 9 and one["empty.csv"].df.dtypes == [("p", "double"), ("q", "double")]


def test_bad_file_is_reported(spark, tmp_path):
    put(tmp_path, "bad.parquet", "no parquet at all")
    put(tmp_path, "ok.csv", "a\n1\n")
    found, errors = inbox.scan_inbox(spark, str(tmp_path), ["csv", "parquet"])
    assert [d.label for d in found] == ["ok.csv"] and [e[0] for e in errors] == ["bad.parquet"]


@pytest.mark.parametrize("rows", [5, 50000])
def test_one_hash_for_files_of_any_size(spark, tmp_path, rows):
    lines = [f"{i}\n" for i in range(rows)]
    path = put(tmp_path, "Vendas 2024+x.csv", "".join(lines))
    put(tmp_path, "second.csv", "a")
    put(tmp_path, "other.bin", "x")

    def hashes():
        return {r.source_file: r.file_hash for r in inbox.file_hashes(spark, str(tmp_path), ["*.CSV"]).collect()}

    first = hashes()
    assert set(first) == {"Vendas 2024+x.csv", "second.csv"} and len(set(first.values())) == 2
    seen = {first["Vendas 2024+x.csv"]}

    def changed(text):
        with open(path, "w") as f:
            f.write(text)
        now = hashes()["Vendas 2024+x.csv"]
        assert now not in seen
        seen.add(now)

    changed("".join(reversed(lines)))
    changed("".join([*lines[:2], lines[3], lines[2], *lines[4:]]))  # two neighbours swapped
    changed("".join([*lines[:-1], *lines[-1:], "\n"]))  # an empty line at the end
    changed("".join(["\n", *lines]))  # and at the start
    changed("".join(lines).rstrip())
    changed("".join(lines) + "7\n")
    with open(path, "w") as f:
        f.writelines(lines)
    assert hashes() == first


@pytest.mark.parametrize("split", ["1k", "7k", "1g"])
def test_a_hash_does_not_depend_on_splits(spark, tmp_path, split):
    """However a file is cut and its splits are packed into partitions, its digest is that of the whole sequence."""
    lines = [f"line {i * i}" for i in range(3000)] + ["", "", "x" * 3000, "last without end"]
    put(tmp_path, "a.csv", "\n".join(lines))
    put(tmp_path, "b.csv", "\n".join(lines[5:2000]) + "\n")
    pieces = spark.createDataFrame([(n, 0, x) for n, own in (("a.csv", lines), ("b.csv", lines[5:2000])) for x in own],
                                   "name string, start bigint, value string").coalesce(1)
    whole = {r.name: r.digest for r in digest.file_digests(pieces, "name", "start", "value").collect()}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = spark.read.option("lineSep", "\n").text(str(tmp_path)).select(
            F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), "value")
        assert {r.name: r.digest for r in digest.file_digests(rows, "name", "start", "value").collect()} == whole
        assert {r.source_file for r in inbox.file_hashes(spark, str(tmp_path)).collect()} == {"a.csv", "b.csv"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_powers(spark):
    exponents = [0, 1, 2047, 2048, 123456789, (1 << 22) + 5, (1 << 33) - 1]
    rows = spark.createDataFrame([(e,) for e in exponents], "e bigint").select(
        "e", *[digest.power(i, F.col("e")).alias(f"p{i}") for i in range(4)]).collect()
    assert all(r[f"p{i}"] == pow(digest.BASES[i], r.e, digest.PRIMES[i]) for r in rows for i in range(4))


def test_surplus_fields_are_an_error(spark, tmp_path):
    put(tmp_path, "a.csv", 'a,b\n1,2\n3,4,5\n')
    put(tmp_path, "b.csv", 'a,b\n"1,5",2\n3\n')
    found, errors = inbox.scan_inbox(spark, str(tmp_path), ["csv"])
    assert errors == [("a.csv", "1 rows have more than 2 fields")]
    assert sorted((r.a, r.b) for r in found[0].df.collect()) == [("1,5", 2), ("3", None)]


def test_bad_file_stops_neither_batch_nor_stream(spark, tmp_path):
    box = tmp_path / "in"
    os.mkdir(box)
    put(box, "bad.parquet", "no parquet at all")
    put(box, "x.csv", "a;b\n1;2\n")
    put(box, "y.csv", "a;b\n1;2\n")
    staging = str(tmp_path / "staging")
    got = batch.run_inbox(spark, str(box), str(tmp_path / "log"), AT, AT, staging=staging).collect()
    assert [r.source_file for r in got] == ["x.csv", "y.csv"]
    assert spark.read.parquet(f"{staging}/{got[0].table_name}").count() == 1
    stream.scan_new_files(spark, str(box), str(tmp_path / "out"), str(tmp_path / "mark"), "inc", AT)
    assert spark.read.parquet(str(tmp_path / "out")).select("dataset_name").distinct().count() == 2


def broken_parquet(spark, tmp_path, path):
    """A file whose footer is whole but whose pages are not: it opens, and fails while it is read."""
    folder = str(tmp_path / "made")
    spark.range(1000).selectExpr("id", "md5(cast(id as string)) as s").coalesce(1).write.mode("overwrite").parquet(folder)
    whole = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    with open(os.path.join(folder, whole), "rb") as f:
        data = bytearray(f.read())
    data[4:3000] = bytes(2996)
    with open(path, "wb") as f:
        f.write(data)


def test_files_of_one_stem_and_a_file_that_breaks_while_read(spark, tmp_path):
    """a.csv and a.parquet are two tables; a file that fails while it is judged costs neither them nor the rest."""
    box, log, staging = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "staging")
    os.mkdir(box)
    put(box, "a.csv", "x;y\n1;2\n")
    put(box, "good.csv", "x;y\n1;2\n3;4\n")
    folder = str(tmp_path / "p")
    spark.range(5).coalesce(1).write.parquet(folder)
    os.rename(os.path.join(folder, next(f for f in os.listdir(folder) if f.endswith(".parquet"))), box / "a.parquet")
    broken_parquet(spark, tmp_path, str(box / "broken.parquet"))
    got = batch.run_inbox(spark, str(box), log, AT, AT, staging=staging).collect()
    assert {(r.source_file, r.table_name, r.total_registros) for r in got} == {
        ("a.csv", "stg.src_a_csv", 1), ("a.parquet", "stg.src_a_parquet", 5), ("good.csv", "stg.src_good", 2)}
    assert spark.read.parquet(f"{staging}/stg.src_a_csv").columns == ["x", "y"]
    stream.scan_new_files(spark, str(box), str(tmp_path / "out"), str(tmp_path / "mark"), "inc", AT)
    assert {r.dataset_name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.csv", "a.parquet", "good.csv"}


def test_a_failed_group_is_judged_file_by_file(spark, tmp_path, caplog):
    good = [(f"g{i}", spark.range(1).select(F.lit(i).alias("v"))) for i in range(3)]
    bad = ("bad", spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("v")))
    out = str(tmp_path / "out")
    batch.write_each([good[0], bad, *good[1:]], lambda df: df.write.mode("append").parquet(out), "judged")
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == [0, 1, 2] and "bad was not judged" in caplog.text


def test_a_log_is_whole_at_every_moment(spark, tmp_path, monkeypatch):
    """A 'replace' that ends before the old rows are removed loses none, and the next one removes them; so for older logs."""
    box, log = tmp_path / "in", str(tmp_path / "log")
    os.mkdir(box)
    put(box, "a b.csv", "x;y\n1;2\n")
    put(box, "c.csv", "x;y\n1;2\n")
    older = spark.createDataFrame([(datetime(2024, 1, 1), "a b.csv", "old"), (datetime(2024, 1, 1), "gone.csv", "old")],
                                  "run_ts timestamp_ntz, source_file string, file_hash string")
    schemas.align(older, schemas.RUN_LOG).coalesce(1).write.parquet(log)

    def rows():
        return sorted((r.source_file, r.run_ts.day) for r in sinks.read_runs(spark, log, schemas.RUN_LOG).distinct().collect())

    batch.run_inbox(spark, str(box), log, AT, AT)
    assert rows() == [("a b.csv", 1), ("a b.csv", 1), ("c.csv", 1), ("gone.csv", 1)]
    kept = sinks.remove
    monkeypatch.setattr(sinks, "remove", lambda fs, files: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        batch.run_inbox(spark, str(box), log, datetime(2024, 3, 2), AT, mode="replace")
    assert {("a b.csv", 2), ("c.csv", 2), ("gone.csv", 1)} <= set(rows())
    monkeypatch.setattr(sinks, "remove", kept)
    last = batch.run_inbox(spark, str(box), log, datetime(2024, 3, 3), AT, mode="replace").collect()
    assert rows() == [("a b.csv", 3), ("c.csv", 3), ("gone.csv", 1)] == sorted((r.source_file, r.run_ts.day) for r in last)
    assert sinks.read_runs(spark, log, schemas.RUN_LOG).where("source_file <> 'gone.csv'").count() == 2


def test_only_a_missing_log_is_empty(spark, tmp_path):
    assert sinks.read_runs(spark, str(tmp_path / "none"), schemas.RUN_LOG).count() == 0
    put(tmp_path, "log", "no parquet at all")
    with pytest.raises(Exception):
        sinks.read_runs(spark, str(tmp_path / "log"), schemas.RUN_LOG).count()


@pytest.mark.parametrize("run_id", ["007", "20240301", "2024-03-01", "a:b c"])
def test_run_ids_stay_as_they_are(spark, tmp_path, run_id):
    found = [ds.Dataset("a", spark.createDataFrame([(1, "a"), (2, None)], "id int, s string"), {"dataset_name": "a"})]
    rules = {"a": {"columns": {"id": {"unique": True}}}}
    paths = scan.run_scan(found, rules, run_id, AT, str(tmp_path))
    assert set(paths) == set(scan.RESULT_TABLES)
    for name, path in paths.items():
        layout = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("dataset_name", T.StringType())])
        assert {r.run_id for r in spark.read.schema(layout).parquet(path).collect()} == {run_id}, name
    again = scan.run_scan(found, {}, run_id, AT, str(tmp_path))
    assert "rule_results" not in again
    assert sinks.read_runs(spark, paths["rule_results"], schemas.RULE_RESULTS).count() == 0
    assert sinks.read_runs(spark, paths["table_scores"], schemas.TABLE_SCORES).count() == 1


def test_modes(spark):
    hashes = spark.createDataFrame([("p1", "a", "csv", "h1"), ("p2", "b", "csv", "h2")],
                                   "path string, source_file string, ext string, file_hash string")
    log = spark.createDataFrame([("a", "h1"), ("b", "old")], "source_file string, file_hash string")
    assert [r.source_file for r in inbox.changed_files(hashes, log).collect()] == ["b"]
    assert inbox.changed_files(hashes, log, "append").count() == 2
    assert inbox.kept_log(log, hashes.where("source_file = 'a'"), "replace").first().source_file == "b"
    with pytest.raises(ValueError):
        inbox.changed_files(hashes, log, "other")


def test_inbox_run_modes(spark, tmp_path):
    box, log = tmp_path / "in", str(tmp_path / "log")
    os.mkdir(box)
    put(box, "Vendas 2024.csv", "Id Pedido;Data\n1;2024-02-29\n2;2024-03-01\n;\n")
    first = batch.run_inbox(spark, str(box), log, AT, AT).collect()
    assert [(r.table_name, r.total_registros, r.completude) for r in first] == [("stg.src_vendas_2024", 2, 10.0)]
    later = datetime(2024, 3, 2)
    batch.run_inbox(spark, str(box), log, later, later)
    assert sinks.read_runs(spark, log, schemas.RUN_LOG).count() == 1
    batch.run_inbox(spark, str(box), log, later, later, mode="append")
    assert sinks.read_runs(spark, log, schemas.RUN_LOG).count() == 2
    last = batch.run_inbox(spark, str(box), log, datetime(2024, 3, 3), later, mode="replace").collect()
    assert [r.run_ts for r in last] == [datetime(2024, 3, 3)]
    assert sinks.read_runs(spark, log, schemas.RUN_LOG).count() == 1


def test_incremental(spark, tmp_path):
    box, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    os.mkdir(box)
    put(box, "a.csv", "x\n1\n2\n")
    stream.scan_new_files(spark, str(box), out, mark, "inc", AT)
    put(box, "b.csv", "y\n1\n")
    stream.scan_new_files(spark, str(box), out, mark, "inc", AT)
    got = {(r.run_id, r.dataset_name, r.column_name, r.total) for r in spark.read.parquet(out).collect()}
    assert got == {("inc_000000", "a.csv", "x", 2), ("inc_000001", "b.csv", "y", 1)}


def test_table_stream(spark, tmp_path):
    box, out, mark = str(tmp_path / "t"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.range(5).write.parquet(box)
    stream.scan_table_stream(spark, box, "id bigint", out, mark, "t", "inc", AT)
    spark.range(5, 8).write.mode("append").parquet(box)
    stream.scan_table_stream(spark, box, "id bigint", out, mark, "t", "inc", AT)
    assert {(r.run_id, r.total, r.min_value) for r in spark.read.parquet(out).collect()} == {
        ("inc_000000", 5, "0"), ("inc_000001", 3, "5")}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.write_run(spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, v int"), path)
    sinks.write_run(spark.createDataFrame([("b", 3)], "run_id string, v int"), path)
    assert {tuple(r) for r in spark.read.parquet(path).select("run_id", "v").collect()} == {("a", 1), ("b", 3)}
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), "t", "other")


def test_catalog_sink(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS gauge_test LOCATION '{tmp_path}'")
    try:
        for mode, n in (("append", 3), ("append", 6), ("replace", 3)):
            sinks.write_table(spark.range(3), "gauge_test.t", mode)
            assert ds.scan_table(spark, "gauge_test.t").df.count() == n
        d = ds.scan_table(spark, "gauge_test.t", limit=2)
        assert d.df.count() == 2 and (d.label, d.meta["table_name"]) == ("gauge_test.t", "t")
    finally:
        spark.sql("DROP DATABASE gauge_test CASCADE")


def test_align(spark):
    df = schemas.align(spark.createDataFrame([(1, "x")], "b int, z string"),
                       T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())]))
    assert df.dtypes == [("a", "string"), ("b", "bigint")] and tuple(df.first()) == (None, 1)


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in ds.sample_rows(d, 50, "id").collect()) for d in (df, df.repartition(9)))
    assert a == b and len(a) == 50


def test_scan_run_replaces_itself(spark, tmp_path):
    found = [ds.Dataset(n, spark.createDataFrame([(1, "a"), (2, None)], "id int, s string"), {"dataset_name": n})
             for n in ("a", "b", "c")]
    rules = {"a": {"columns": {"id": {"unique": True}, "s": {"not_null": True}}}}
    for datasets in (found, found[:2]):
        paths = scan.run_scan(datasets, rules, "r1", AT, str(tmp_path), batch=2)
    scan.run_scan(found[:1], rules, "r2", AT, str(tmp_path))
    tables = {n: spark.read.parquet(p) for n, p in paths.items()}
    assert {(r.run_id, r.dataset_name) for r in tables["table_scores"].collect()} == {("r1", "a"), ("r1", "b"), ("r2", "a")}
    assert tables["column_metrics"].where("run_id = 'r1'").count() == 4
    passed = {(r.column_name, r.passed, r.rule_score) for r in tables["rule_results"].where("run_id = 'r2'").collect()}
    assert passed == {("id", True, 1.0), ("s", False, 0.5)}
    assert set(tables["table_scores"].columns) == {f.name for f in schemas.TABLE_SCORES.fields}


def test_sources_mapping(spark, tmp_path):
    put(tmp_path, "a.csv", "x;y\n1;2\n")
    found, errors = inbox.scan_sources(spark, {
        "files": {"inbox": str(tmp_path), "include_ext": ["csv"], "csv_sep": ";"},
        "databases": [{"name": "d", "type": "postgres", "host": "h"}, {"name": "e", "type": "nosuch"}]})
    assert [d.df.columns for d in found] == [["x", "y"]]
    assert errors == [("d", "missing settings: db, user, password"), ("e", "unknown database kind: 'nosuch'")]


# --- databases: settings and queries only, as no database may be started here ----------------------

def test_jdbc_settings():
    s = jdbc.JdbcSource.from_config({"type": "postgres", "host": "h", "db": "d", "user": "u", "password": "p",
                                     "include_tables": ["public.a", "b"], "limit": 5, "only": "^[ab]$"})
    assert s.options() == {"url": "jdbc:postgresql://h:5432/d", "driver": "org.postgresql.Driver", "fetchsize": "10000",
                           "user": "u", "password": "p"}
    assert s.missing_fields() == [] and s.schemas == ["public"] and s.reference == "h:5432/d"
    assert s.table_query("public", 'we"ird') == 'SELECT * FROM "public"."we""ird" LIMIT 5'
    assert [t for t in ("a", "b", "c") if s.wants("public", t)] == ["a", "b"]
    assert "table_schema = 'o''x'" in s.catalog_query("o'x")


@pytest.mark.parametrize("kind,url,query", [
    ("mysql", "jdbc:mysql://h:3306/d", "SELECT * FROM `s`.`t` LIMIT 7"),
    ("mariadb", "jdbc:mariadb://h:3306/d", "SELECT * FROM `s`.`t` LIMIT 7"),
    ("sqlserver", "jdbc:sqlserver://h:1433;databaseName=d", "SELECT TOP 7 * FROM [s].[t]"),
    ("oracle", "jdbc:oracle:thin:@//h:1521/d", 'SELECT * FROM "s"."t" FETCH FIRST 7 ROWS ONLY'),
    ("sqlite", "jdbc:sqlite:/f", 'SELECT * FROM "s"."t" LIMIT 7'),
    ("duckdb", "jdbc:duckdb:/f", 'SELECT * FROM "s"."t" LIMIT 7')])
def test_jdbc_dialects(kind, url, query):
    s = jdbc.JdbcSource(kind, host="h", db="d", user="u", password="p", dbfile="/f", limit=7)
    assert s.options()["url"] == url and s.table_query("s", "t") == query and s.missing_fields() == []


def test_jdbc_uncapped_reads_in_ranges():
    s = jdbc.JdbcSource("postgres", host="h", db="d", user="u", password="p")
    assert s.table_query("s", "t") is None
    fields = [("n", T.StringType()), ("x", T.DoubleType()), ("id", T.LongType())]
    assert jdbc.range_column(T.StructType([T.StructField(*f) for f in fields])) == "id"
    assert jdbc.range_column(T.StructType([T.StructField("n", T.StringType())])) is None


# --- shared folder ---------------------------------------------------------------------------------

class _Session:
    """Stands in for a session with the given settings."""

    def __init__(self, master, folder=None):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": master})


def test_shared_folder_follows_the_session():
    assert session.shared_dir(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.work_path(_Session("yarn", "/s"), "a") != session.work_path(_Session("yarn", "/s"), "a")
    with pytest.raises(RuntimeError):
        session.shared_dir(_Session("yarn"))
    assert session.shared_dir(_Session("local[2]")) == session.shared_dir(_Session("local[2]"))
