"""Profiles that grow with their table, against the profile of all rows at once."""

import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakegauge.operators import running
from lakegauge.operators.profile import PROFILE, cell_keys, profile
from lakegauge.streaming import inbox as stream

AT = datetime(2024, 3, 1, 8, 0)
SCHEMA = ("i int, l bigint, d double, f float, m decimal(20,3), b boolean, s string, dt_x string, bin binary, day date, ts timestamp, tn timestamp_ntz, "
          "a array<int>, ninth int, tenth string")


def rows(start, end):
    out = []
    for i in range(start, end):
        out.append((i % 7 if i % 5 else None, i << 40, float("nan") if i % 11 == 0 else i / 3, -i * 1.5, Decimal(i) / 8, i % 2 == 0,
                    f'{{"k": {i % 4}}}' if i % 3 else ["", "  ", "x" * (i % 90), None][i % 4], f"2024-01-{i % 40:02d}", bytes([i % 256]),
                    date(2020, 1, 1 + i % 28), datetime(2024, 10, 27, i % 24, 0, i % 60, i), datetime(2024, 1, 1, i % 24), [i % 3], 9, None))
    return out


def same(spark, got, df, **options):
    want = [r.asDict() for r in profile(df, **options).orderBy("ordinal").collect()]
    assert [{k: r[k] for k in PROFILE.fieldNames()} for r in sorted(got, key=lambda r: r["ordinal"])] == want


@pytest.mark.parametrize("distinct", ["exact", "approx", "none"])
def test_states_merge_into_the_whole_profile(spark, distinct):
    cut = [0, 1, 40, 300]
    parts = [spark.createDataFrame(rows(a, b), SCHEMA) for a, b in zip(cut, cut[1:])] + [spark.createDataFrame([], SCHEMA)]
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2])
    state, known = None, spark.createDataFrame([], running.KEYS)
    for part in parts:
        now = running.measured(part, lexical=True, sketches=distinct == "approx")
        state = running.merged(now if state is None else now.unionByName(state), whole.schema)
        if distinct == "exact":
            fresh = running.new_keys(cell_keys(part), known)
            state, known = running.with_keys(state, fresh), known.unionAll(fresh)
        state = spark.createDataFrame(state.collect(), running.STATE)
    same(spark, running.profile_of(state, whole.schema, distinct).collect(), whole, distinct=distinct, lexical=True)


def test_growing_table_is_read_once(spark, tmp_path):
    """Three starts over a folder whose older files have gone: every run is the profile of all rows so far."""
    box, out, mark, state = (str(tmp_path / n) for n in ("t", "out", "mark", "state"))
    seen = None
    for start, a, b in ((0, 0, 50), (1, 50, 60), (2, 10, 200)):
        part = spark.createDataFrame(rows(a, b), SCHEMA)
        if seen is not None:
            for f in os.listdir(box):
                os.remove(os.path.join(box, f))
        part.coalesce(1).write.mode("append").parquet(box)
        seen = part if seen is None else seen.unionAll(part)
        stream.scan_growing_table(spark, box, part.schema, out, mark, state, "t", "inc", AT)
        got = spark.read.schema(stream.PROFILE_RUNS).parquet(out).where(F.col("run_id") == f"inc_{start:06d}").collect()
        assert {(r.dataset_name, r.scanned_at) for r in got} == {("t", AT)}
        same(spark, got, seen)
    assert sorted(os.listdir(os.path.join(state, "states"))) == ["step=1", "step=2"]


def test_a_repeated_step_replaces_itself(spark, tmp_path):
    """A batch whose results were written but not committed is measured again with the same outcome."""
    box, out, mark, state = (str(tmp_path / n) for n in ("t", "out", "mark", "state"))
    for a, b in ((0, 30), (20, 70)):
        spark.createDataFrame(rows(a, b), SCHEMA).coalesce(1).write.mode("append").parquet(box)
        stream.scan_growing_table(spark, box, spark.createDataFrame([], SCHEMA).schema, out, mark, state, "t", "inc", AT)
    os.remove(os.path.join(mark, "commits", "1"))
    if os.path.exists(crc := os.path.join(mark, "commits", ".1.crc")):
        os.remove(crc)
    stream.scan_growing_table(spark, box, spark.createDataFrame([], SCHEMA).schema, out, mark, state, "t", "inc", AT)
    got = spark.read.schema(stream.PROFILE_RUNS).parquet(out).where("run_id = 'inc_000001'").collect()
    same(spark, got, spark.createDataFrame(rows(0, 30) + rows(20, 70), SCHEMA))
