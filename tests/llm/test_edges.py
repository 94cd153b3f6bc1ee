"""Every operator on nulls, empty and long texts, repeated rows, an empty table, and columns with clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.llm import jaccard, language, lines, maxent, packing, pieces, quality, secrets, simhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, digest int, n int, id int, key int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20000))


def rows():
    base = [(1, "the cat sat on the mat and the dog lay by the door", "en", "a"), (1, "the cat sat on the mat and the dog lay by the door", "en", "a"),
            (2, None, "en", None), (3, "", None, "a"), (4, " \t\n ", "en", "b"), (None, "le chat est sur la table et le chien dort", "fr", "b"),
            (5, LONG, "en", "a"), (6, "12345 !!! 678", "en", "a"), (7, "x", "en", "a"), (7, "y z", None, "a")]
    return [(*r, None if r[1] is None else len(r[1]), "s", 1, 2, 3, 4) for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(docs):
    return docs.where("false")


def test_language(docs):
    known = language.profiles(docs)
    got = language.identify(docs, known, ["doc_id", "text"]).collect()
    assert len(got) == 10 and {r.lang_pred for r in got if not any(c.isalpha() for c in r.text or "")} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got if r.doc_id is None} == {"fr"}
    assert language.profiles(empty(docs)) == {} and language.identify(empty(docs), known, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.identify(docs, {}, ["doc_id"]).collect()} == {"und"}


def test_jaccard(docs):
    got = sorted(tuple(r) for r in jaccard.linked(docs.where("doc_id is not null"), width=4, percent=85).collect())
    assert [(a, c) for a, _, c in got] == [(1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7)]
    assert dict((a, n) for a, n, _ in got if a not in (1, 5, 7)) == {2: 0, 3: 0, 4: 0, 6: 1}
    assert jaccard.linked(docs).count() == 10 and jaccard.linked(empty(docs)).count() == 0


def test_substring(docs):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(docs, window=5).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (1, 13, 13, nothing) in got and (2, 0, 0, nothing) in got and (3, 0, 0, nothing) in got and (4, 0, 0, nothing) in got
    assert (5, 20000, 0, hashlib.sha256(LONG.encode()).hexdigest()) in got
    assert substring.report(empty(docs)).count() == 0
    left = substring.without_repeats(docs, window=5)
    assert left.columns == docs.columns and left.count() == 10 and left.where("doc_id = 2 and text is null").count() == 1


def test_marks_of_a_long_text_come_together(spark):
    """A text of three numbers, 7 to 9, and its neighbour 10: all marks lie beside the one row of the text."""
    size = 1 << substring._PLACE
    edges = spark.createDataFrame([(7, b"a", "t", 2 * size + 5), (10, b"b", "u", 40)], "number bigint, digest binary, text string, n_words bigint")
    marks = spark.createDataFrame([(7 * size + 3, 1), (8 * size, 2), (9 * size + 4, 1), (10 * size + 2, 1)], "at bigint, length bigint")
    got = sorted((r.part, r.kind, r["at"] // size) for r in substring._beside_texts(edges, marks, whole=True).collect())
    assert got == [(7, 0, 7), (7, 1, 7), (7, 1, 8), (7, 1, 9), (10, 0, 10), (10, 1, 10)]


def test_numbers_run_on_over_any_number_of_splits(spark):
    """Splits far beyond 2**17: coordinates stay positive, distinct and in the order of the splits."""
    size = 1 << substring._PLACE
    rows = [(3, 0, 10), (3, 1, 2 * size), (3, 4, 7), (300000, 0, 5), (300000, 1, 5), (2**31 - 1, 0, size)]
    got = substring.numbered(spark.createDataFrame(rows, "split int, number bigint, n_words bigint")).collect()
    assert sorted((r.number, r.n_words) for r in got) == [(0, 10), (1, 2 * size), (4, 7), (5, 5), (6, 5), (7, size)]


def test_secrets(docs):
    assert all(not r.spans for r in secrets.scan(docs, ["doc_id"]).collect())
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and sorted(map(repr, clean.collect())) == sorted(map(repr, docs.collect()))
    assert secrets.scan(empty(docs), ["doc_id"]).count() == 0


def test_packing(docs):
    got = packing.packed(packing.pieces(docs, ["doc_id"])).collect()
    assert sum(r.length for r in got if r.start == 0 and r.doc_id in (2, 3, 4)) == 3  # the end token alone
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert packing.packed(packing.pieces(empty(docs), ["doc_id"])).count() == 0


def test_quality_takes_one_text_an_id(spark):
    rows = [(i, f"word{i} and some more of {i % 3}") for i in range(8)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int")
    once = quality.train(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    often = quality.train(spark.createDataFrame(rows + [rows[3]] * 40, "doc_id bigint, text string"), labels)
    assert often.bias == once.bias and (often.weight == once.weight).all()


def test_quality(docs, spark):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (5, 1, "x"), (None, 1, "x"), (6, None, "x"), (99, 1, "x")], "doc_id bigint, quality int, text string")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model, ["doc_id", "score"]).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.scored(empty(docs), model, ["doc_id"]).count() == 0
    bare = quality.train(docs, labels.where("false"))
    assert {r.score for r in quality.scored(docs, bare, ["doc_id"]).collect()} == {0.5}


def test_maxent(docs):
    got = maxent.scored(docs, F.lit(True), ["doc_id"]).collect()
    assert len(got) == 10 and all(r.score < 0 and r.base_score < 0 and r.n_known == r.n_tokens for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    bare = maxent.scored(docs, F.lit(None).cast("boolean"), ["doc_id"]).collect()
    assert {(r.train_tokens, r.n_known) for r in bare} == {(0, 0)}
    assert maxent.scored(empty(docs), F.lit(True), ["doc_id"]).count() == 0


def test_maxent_answers_go_together(spark):
    """What a task knows of a block's words is a few packed rows; a row for each word, with empty lists beside it, took
    longer to send than all the rest."""
    known = spark.range(0, 30000, 1, 3).select(F.shiftleft(F.col("id") % 2, 33).alias("block"), (F.col("id") * 7919 % 30000).cast("int").alias("code"),
                                               (F.col("id") * (1 << 30)).alias("n"))
    got = maxent._answers(known).collect()
    assert len(got) == 6 and {r.block for r in got} == {0, 1 << 33}
    pairs = {(r.block, c, n) for r in got for c, n in zip(np.cumsum(maxent._unpack(r.codes, "<i8")).tolist(), maxent._unpack(r.times, "<i8").tolist())}
    assert pairs == {tuple(r) for r in known.collect()}


def test_maxent_steps_are_mean_gradients():
    rng = np.random.default_rng(1)
    index, gradient = rng.integers(0, 40, (3, 500)), rng.random((500, 8), np.float32)
    table, used = rng.random((50, 8), np.float32), np.zeros(50)
    want, count = table.astype(np.float64), np.zeros(50)
    for ids in index:
        n = np.bincount(ids, minlength=50)
        for row in np.flatnonzero(n):
            want[row] -= 0.6 * gradient[ids == row].sum(axis=0, dtype=np.float64) / (n[row] + 4)
        count += n
    maxent._step(table, used, index, gradient, 0.6)
    assert np.allclose(table, want, atol=1e-5) and (used == count).all()


def test_lines(docs):
    got = {(r.doc_id, r.n_words, r.base_failed, r.kept) for r in lines.judged(docs).collect()}
    assert (5, 20000, False, True) in got and (2, 0, True, False) in got and (1, 13, True, False) in got
    assert lines.judged(docs).count() == 10 and lines.judged(empty(docs)).count() == 0


def test_pieces(docs):
    got = pieces.round_trip(docs, ["doc_id", "text"]).collect()
    assert len(got) == 10 and all(r.lossless for r in got)
    assert all(r.n_tokens == 0 for r in got if not r.text) and pieces.round_trip(empty(docs), ["doc_id"]).count() == 0


def test_simhash(docs):
    got = simhash.report(docs).collect()
    assert len(got) == 10 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert [r.near_next for r in got if r.doc_id is None] == [0.0]
    one = simhash.report(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0 and simhash.report(empty(docs)).count() == 0
