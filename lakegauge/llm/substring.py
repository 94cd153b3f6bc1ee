"""Removal of word sequences that occur more than once, by compaction of a De Bruijn graph.

An edge of the graph is a window of `window` words, written as a 64-bit hash; neighbouring windows of a text are
neighbouring edges. Only windows that can repeat become edges: a window is stood for by the least of its k-mers, which
equal windows share, so windows whose k-mer is found in one place only are left out before anything is shuffled.

Each repeated edge takes its first place as its source. A join on the edge gives every occurrence its source, and where
neighbouring occurrences have neighbouring sources the path does not branch and becomes one span. The words of each
span are then compared with those at its source's coordinates, so no hash decides alone what is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lakegauge.llm.common import Words, blocks, bloom, grams, in_bloom, list_array, plain, settled, spread, stored, text_of

WINDOW = 35
_K = 12
_PLACE = 24  # a coordinate is a text's number, then this many bits for the place of a word in it
_BLOCK = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; for each window the least of its k-mers and that k-mer's place; and where windows start.

    All are over the whole block; the last array holds the starts of windows that lie within one text.
    """
    k = min(_K, window)
    hashes = words.hashes()[words.codes]
    least, width = grams(hashes, k), window - k + 1
    place = np.arange(len(least), dtype=np.int64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        lower = least[step:] < least[:len(least) - step]
        place = np.where(lower, place[step:], place[:len(place) - step])
        least = np.where(lower, least[step:], least[:len(least) - step])
        reach += step
    room = np.maximum(0, words.counts - window + 1)
    starts = np.repeat(words.at[:-1], room) + _ramps(room)
    return hashes, least, place, starts


def _ramps(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """digest of the text, key of id and text together, text."""
    c = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").alias("id"), c.alias("text"))
    return rows.select("id", text_digest("text").alias("digest"), F.xxhash64(text_digest("text"), "id").alias("key"), "text")


def text_digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")))


def _scanned(rows: DataFrame, window: int) -> DataFrame:
    """One row per distinct text: digest, key of the document that stands for it, copies, n_words, sha of its words,
    and the k-mers that stand for its windows."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", _BLOCK):
            texts = text_of(part, "text")
            words = Words(texts)
            _, least, place, starts = _anchors(words, window)
            owner = np.searchsorted(words.at, starts, side="right") - 1
            new = np.ones(len(starts), bool)
            new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (owner[1:] != owner[:-1])
            at = np.searchsorted(owner[new], np.arange(len(texts) + 1))
            kept = least[starts[new]]
            shas = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.array(shas, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(kept.view(np.int64)))],
                names=["digest", "key", "n_words", "sha", "anchors"])

    each = rows.select("digest", "key", "text").mapInArrow(
        scan, "digest binary, key bigint, n_words bigint, sha binary, anchors array<bigint>")
    return stored(each.groupBy("digest").agg(
        F.min("key").alias("key"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
        F.first("sha").alias("sha"), F.first("anchors").alias("anchors")), "texts")


def _edges(rows: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(number, digest, text, edges, from, runs): the windows of each text whose k-mer occurs in more than one place.

    Their starts are ramps: runs[i] windows from from[i] on. Numbers are given while the rows are written, once.
    """
    context = rows.sparkSession.sparkContext
    places = texts.select(F.explode("anchors").alias("a")).groupBy("a").count().where("count > 1")
    anchors = context.broadcast(bloom(places, "a"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            hit = np.concatenate([[0], np.cumsum(in_bloom(anchors.value, lists.flatten().to_numpy().view(np.uint64)))])
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit[at[1:]] > hit[at[:-1]]))], names=["key"])

    keys = context.broadcast(bloom(texts.where(F.size("anchors") > 0).select("key", "anchors").mapInArrow(some, "key bigint"), "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number = TaskContext.get().partitionId(), 0
        for part in blocks(batches, "text", _BLOCK):
            wanted = part.filter(pa.array(in_bloom(keys.value, part.column(1).to_numpy().view(np.uint64))))
            if not wanted.num_rows:
                continue
            texts = text_of(wanted, "text")
            words = Words(texts)
            hashes, least, _, starts = _anchors(words, window)
            starts = starts[in_bloom(anchors.value, least[starts])]
            edges = grams(hashes, window)[starts]
            owner = np.searchsorted(words.at, starts, side="right") - 1
            at = np.searchsorted(owner, np.arange(len(texts) + 1))
            fresh = np.ones(len(starts), bool)
            fresh[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
            heads = np.flatnonzero(fresh)
            runs = np.diff(np.concatenate([heads, [len(starts)]]))
            run_at = np.searchsorted(owner[heads], np.arange(len(texts) + 1))
            # a text longer than a place can say takes several numbers
            numbers = number + np.concatenate([[0], np.cumsum(1 + (words.counts >> _PLACE))])
            number = int(numbers[-1])
            lists = lambda flat, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(texts), split, np.int32)), pa.array(numbers[:-1]), wanted.column(0), texts, pa.array(words.counts, pa.int64()),
                 lists(edges.view(np.int64), at), lists((starts - words.at[owner])[heads], run_at), lists(runs, run_at)],
                names=["split", "number", "digest", "text", "n_words", "edges", "from", "runs"])

    return numbered(stored(rows.select("digest", "key", "text").mapInArrow(
        scan, "split int, number bigint, digest binary, text string, n_words bigint, edges array<bigint>, `from` array<bigint>, "
              "runs array<bigint>").where(F.size("edges") > 0), "edges"))


def numbered(edges: DataFrame) -> DataFrame:
    """The texts with numbers that run on from split to split, from those that begin at 0 in each.

    So coordinates need as many bits as there are texts, whatever the number of splits: 2**39 texts fit.
    """
    sizes = edges.groupBy("split").agg(F.max(F.col("number") + F.shiftright("n_words", _PLACE) + 1).alias("n"))
    # one row per split, in one task and then broadcast
    before = F.coalesce(F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stored(sizes.select("split", before.alias("first")), "splits")
    return edges.join(F.broadcast(first), "split").withColumn("number", F.col("first") + F.col("number")).drop("split", "first")


def _spans(edges: DataFrame) -> DataFrame:
    """(number, start, length, source): unbranched paths of repeated windows, each with the coordinate it repeats.

    `length` counts windows. The source's own occurrence is left out.
    """
    starts = F.flatten(F.transform(F.arrays_zip("from", "runs"), lambda r: F.sequence(r["from"], r["from"] + r["runs"] - 1)))
    base = F.shiftleft("number", _PLACE)
    rows = edges.select(base.alias("base"), F.inline(F.arrays_zip(F.col("edges").alias("edge"), starts.alias("start")))) \
        .select("edge", (F.col("base") + F.col("start")).alias("at"))
    sources = stored(rows.groupBy("edge").agg(F.count("*").alias("n"), F.min("at").alias("source")).where("n > 1"), "sources")
    # an edge that a third of the texts hold is no task of its own: edges met often are few by arithmetic, at most four a
    # task, so they are broadcast, and only the others are dealt by edge
    total = sources.agg(F.sum("n")).first()[0] or 0
    limit = max(1000, total // (4 * spread(edges.sparkSession)))
    many, few = (sources.where(c).select("edge", "source") for c in (F.col("n") > limit, F.col("n") <= limit))
    seldom = rows.join(F.broadcast(many.select("edge")), "edge", "left_anti")
    found = rows.join(F.broadcast(many), "edge").unionByName(seldom.join(few, "edge")) \
        .where(F.col("at") != F.col("source")).select("at", "source")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, source = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(at):
                continue
            head = np.ones(len(at), bool)
            head[1:] = (np.diff(at) != 1) | (np.diff(source) != 1)
            heads = np.flatnonzero(head)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[heads]), pa.array(np.diff(np.concatenate([heads, [len(at)]]))), pa.array(source[heads])],
                names=["at", "length", "source"])

    # a path cut by the end of a batch is two spans, which is as good
    return found.repartition(spread(edges.sparkSession), F.shiftright("at", _PLACE)).sortWithinPartitions("at") \
        .mapInArrow(compact, "at bigint, length bigint, source bigint")


def _beside_texts(edges: DataFrame, asked: DataFrame, whole: bool = False) -> DataFrame:
    """Every text followed by the rows (at, length) that ask about it, in order of place, for one pass.

    A text of several numbers comes once for each of them, or, as a whole, once with all rows that ask about it.
    """
    part = F.shiftright("at", _PLACE)
    numbers = F.explode(F.sequence(F.col("number"), F.col("number") + F.shiftright("n_words", _PLACE)))
    if whole:
        more = edges.where(F.col("n_words") >= 1 << _PLACE).select(numbers.alias("part"), "number")
        asked = asked.withColumn("part", part).join(more, "part", "left")
        part, numbers = F.coalesce("number", "part"), F.col("number")
    texts = edges.select(numbers.alias("part"), F.col("number"), "digest", "text")
    rows = texts.select("part", F.lit(0).alias("kind"), F.shiftleft("number", _PLACE).alias("at"),
                        F.lit(0).cast("bigint").alias("length"), "digest", "text") \
        .unionByName(asked.select(part.alias("part"), F.lit(1).alias("kind"), "at", "length"),
                     allowMissingColumns=True)
    return rows.repartition(spread(edges.sparkSession), "part").sortWithinPartitions("part", "kind", "at")


def _digests(edges: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(at, length, said): a 128-bit digest of the words under each asked run of windows."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = [], 0
        for b in batches:
            kind, at, length = (b.column(i).to_pylist() for i in (1, 2, 3))
            text = b.column(5)
            out = []
            for i, k in enumerate(kind):
                if k == 0:
                    words, base = text[i].as_buffer().to_pybytes().split(), at[i]
                else:
                    span = words[at[i] - base:at[i] - base + length[i] + window - 1]
                    out.append((at[i], length[i], hashlib.blake2b(b" ".join(span), digest_size=16).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], pa.binary())], names=["at", "length", "said"])

    return _beside_texts(edges, asked).mapInArrow(read, "at bigint, length bigint, said binary")


def _verified(edges: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(at, length): the windows whose words are found elsewhere too, word by word."""
    here, there = spans.select("at", "length"), spans.select(F.col("source").alias("at"), "length")
    said = stored(_digests(edges, here.union(there).distinct(), window), "said")
    mine = said.select("at", "length", F.col("said").alias("own"))
    other = said.select(F.col("at").alias("source"), "length", F.col("said").alias("first"))
    judged = stored(spans.join(mine, ["at", "length"]).join(other, ["source", "length"])
                    .select("at", "source", "length", (F.col("own") == F.col("first")).alias("same")), "judged")
    good = judged.where("same")
    marks = good.select("at", "length").union(good.select(F.col("source").alias("at"), "length")).distinct()
    bad = judged.where("not same")
    if not bad.isEmpty():
        # different words under one hash: their windows are compared one by one by their words
        step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1))
        each = bad.select("at", "source", step.alias("i")).select(
            F.explode(F.array(F.col("at") + F.col("i"), F.col("source") + F.col("i"))).alias("at"), F.lit(1).cast("bigint").alias("length"))
        single = stored(_digests(edges, each.distinct(), window), "said")
        more = single.groupBy("said").count().where("count > 1").select("said")
        marks = marks.union(single.join(more, "said", "left_semi").select("at", "length"))
    return marks


def _kept(edges: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """(digest, n_removed, kept_sha, kept): what is left of each marked text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, digest, base, held = None, b"", 0, []

        def finished():
            places = [m.span() for m in _WORD.finditer(text)]
            gone = np.zeros(len(places) + 1, np.int64)
            start = np.array([a - base for a, _ in held])
            np.add.at(gone, start, 1)
            np.add.at(gone, np.minimum(start + np.array([n for _, n in held]) + window - 1, len(places)), -1)
            stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
            words = [text[slice(*places[i])] for i in stay]
            ends = [p[0] for p in places[1:]] + [len(text)]
            left = text[:places[0][0]] + "".join([text[places[i][0]:ends[i]] for i in stay])
            return digest, len(places) - len(stay), hashlib.sha256(" ".join(words).encode()).digest(), left

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                                               pa.array([o[2] for o in out], pa.binary()), pa.array([o[3] for o in out], pa.string())],
                                              names=["digest", "n_removed", "kept_sha", "kept"])
        for b in batches:
            kind, at, length = (b.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for i, k in enumerate(kind):
                if k:
                    held.append((at[i], length[i]))
                elif text is None or at[i] != base:
                    if held:
                        out.append(finished())
                    text, digest, base, held = b.column(5)[i].as_py(), b.column(4)[i].as_py(), at[i], []
            if out:
                yield batch(out)
        if held:
            yield batch([finished()])

    return _beside_texts(edges, marks, whole=True).mapInArrow(cut, "digest binary, n_removed bigint, kept_sha binary, kept string")


def removed(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct text: digest (see `text_digest`), n_words, n_removed, kept_sha (of the kept words joined by
    one space) and kept, the text without the removed words; kept is null where nothing was removed.

    A word goes if a window of `window` words that covers it starts anywhere else too, in the same or another document;
    windows are those of the input. Null texts are empty; empty texts and texts shorter than a window keep their words.
    A text that occurs twice loses all words if it holds a window. Row order, repeated ids and null ids play no part.
    """
    rows = _keyed(plain(docs, id, text), id, text)
    texts = _scanned(rows, window)

    def kept() -> DataFrame:
        edges = _edges(rows, texts, window)
        spans = settled(docs.sparkSession, "spans", lambda: _spans(edges))
        return _kept(edges, _verified(edges, spans, window), window)

    cut = settled(docs.sparkSession, "kept", kept).dropDuplicates(["digest"]).withColumnRenamed("digest", "d")
    out = texts.join(cut, texts.digest == cut.d, "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    nothing = F.unhex(F.sha2(F.lit(b""), 256))
    return out.select(
        "digest", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256."""
    found = removed(docs, id, text, window).drop("kept").withColumnRenamed("digest", "d")
    rows = docs.select(F.col(f"`{id}`").alias(id), text_digest(text).alias("digest"))
    return rows.join(found, rows.digest == found.d).select(id, "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with the repeated words cut from their texts; null texts stay null."""
    found = removed(docs, id, text, window).select(F.col("digest").alias("__d"), F.col("kept").alias("__kept"))
    rows = docs.withColumn("__digest", text_digest(text)).join(found.where("__kept is not null"), F.col("__digest") == F.col("__d"), "left")
    return rows.select(*[(F.when(F.col(f"`{c}`").isNull(), None).otherwise(F.coalesce("__kept", F.col(f"`{c}`"))) if c == text
                          else F.col(f"`{c}`")).alias(c) for c in docs.columns])
