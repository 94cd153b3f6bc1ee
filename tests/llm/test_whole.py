"""The pipeline from end to end, and language scores against a plain out-of-place distance."""

import collections
import os
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakegauge.llm import language
from lakegauge.llm.common import blocks, settled, stored, text_of
from lakegauge.session import shared_dir

SF = "/root/testdata/sf0.001"
PAD = chr(1)


def ranked_grams(text, size):
    """Letter 1- to 3-grams of a text padded by blanks, most frequent first; ties by length, then by letters."""
    seq = [PAD] + [(c.lower() if len(c.lower()) == 1 and c.lower().isalpha() else c) if c.isalpha() else PAD for c in text] + [PAD]
    counts = collections.Counter(c for c in seq if c != PAD)
    counts.update(a + b for a, b in zip(seq, seq[1:]) if a + b != PAD * 2)
    counts.update(a + b + c for a, b, c in zip(seq, seq[1:], seq[2:]) if b != PAD)
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:size], counts


def test_language_scores_are_out_of_place_distances(spark):
    size = 400
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    totals = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.text is not None and r.lang is not None:
            totals[r.lang].update(ranked_grams(r.text, size)[1])
    known = {n: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], len(g), g))[:size])} for n, c in totals.items()}
    odd = ["", None, "123", "a", "Ünïcödé çà", "日本語 の テスト", "ǅ İ ẞ", "x" * 5000, "ab " * 3000]
    extra = spark.createDataFrame([(100000 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    asked = docs.select("doc_id", "text").unionAll(extra)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, language.profiles(docs), ["doc_id"]).collect()}
    texts = {r.doc_id: r.text for r in rows} | {100000 + i: t for i, t in enumerate(odd)}
    for k, t in texts.items():
        own, _ = ranked_grams(t or "", size)
        far = {n: sum(min(abs(p.get(g, 2 * size) - i), size) for i, g in enumerate(own)) for n, p in known.items()}
        best = min(sorted(far), key=lambda n: far[n])
        want = (best, 1 - far[best] / (len(own) * size)) if own else ("und", 0.0)
        assert got[k][0] == want[0] and abs(got[k][1] - want[1]) < 1e-9, (k, got[k], want)


def test_the_pipeline_runs_from_end_to_end(spark):
    """run() packs exactly what the stages before it keep: every piece of every document left, gapless in its sequence."""
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = [r.doc_id for r in docs.collect()]
    assert len(kept) > 100 and sorted(set(kept)) == sorted({r.doc_id for r in rows})
    by_doc, ends = collections.defaultdict(list), {}
    for r in rows:
        by_doc[r.doc_id].append(r)
    for own in by_doc.values():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == own[0].doc_tokens
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_stages_leave_only_what_their_results_read(spark):
    def found(make):
        before = set(os.listdir(shared_dir(spark)))
        rows = make()
        return rows, sorted(n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before)

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kept, names = found(lambda: corpus_pipeline.one_of_each_group(spark, docs, SF))
    assert names == ["doubtful"] and 0 < kept.count() <= docs.count()
    left, names = found(lambda: corpus_pipeline.without_repeats(spark, docs, SF))
    assert names == ["kept", "texts"] and 0 < left.count() <= docs.count()


def test_what_is_settled_outlives_what_it_was_made_of(spark):
    before = set(os.listdir(shared_dir(spark)))
    first = stored(spark.range(5), "first")

    def make():
        second = stored(first.selectExpr("id + 1 as id"), "second")
        return stored(settled(spark, "third", lambda: stored(second, "fourth").selectExpr("id * 2 as id")), "fifth")

    got = settled(spark, "last", make)
    assert sorted(r.id for r in got.collect()) == [2, 4, 6, 8, 10] and first.count() == 5
    with pytest.raises(ZeroDivisionError):
        settled(spark, "none", lambda: stored(first, "lost").limit(1 // 0))
    assert sorted(n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before) == ["first", "last"]


def test_stages_hand_small_batches_to_python(spark, monkeypatch):
    """Batches of 10000 texts, 20 MB on both sides of each task, took an executor over its memory."""
    before = spark.conf.get(corpus_pipeline.BATCH)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    sizes = long.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint")
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(corpus_pipeline.BATCH, str(64 << 20))
            stage(spark, docs.where("false"), SF)
            seen = sizes.agg(F.max("n"), F.sum("n")).first()
            assert seen[0] < 1.1 * (1 << 20) and seen[1] > 6_000_000, (name, seen)
        spark.conf.set(corpus_pipeline.BATCH, str(64 << 20))
        monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[:1])
        assert corpus_pipeline.run(spark, SF).count() == docs.count()
        assert spark.conf.get(corpus_pipeline.BATCH) == str(64 << 20)
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


def test_language_holds_little_at_once(spark, monkeypatch):
    """Blocks of 1 MB of text took 110 MB of arrays at once, in each worker."""
    made = {}
    monkeypatch.setattr(language, "map_text", lambda docs, keep, text, fields, make, limit: made.update(fn=make(), limit=limit))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    language.identify(docs, language.profiles(docs), [])
    texts = [r.text or "" for r in docs.collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts * (1 + (3 << 20) // sum(map(len, texts))))], names=["text"])
    tracemalloc.start()
    try:
        n = sum(len(made["fn"](text_of(part, "text"), part)[0]) for part in blocks([batch], "text", made["limit"]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == batch.num_rows and peak < 60 << 20, peak / 1e6
