"""Language model: hashed maximum entropy with class-factored softmax, over add-half unigrams.

Words are put into cells: the most frequent ones have cells of their own, the others share cells by their endings. Cells
are grouped into classes. Given the words before, the model predicts the class and then the cell within the class, each
by a softmax over hashed features (the last word, words one and two further back, the last two together); given the
cell, a word has its add-half share of the cell's count. Weights are learned by rounds over disjoint parts of all
training documents: each task takes gradient steps from the shared weights, and the changes, weighted by how often
each weight was used, are summed and averaged.

Counts of words are exact and of any number; they are never gathered in one place. Texts are read in blocks, each block asks
for the counts of its own words, and the answers are brought to the block by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakegauge.llm.common import Words, blocks, list_array, mix, segments, spread, stored, sums, text_hashes, text_of

CLASSES, MEMBERS = 16, 32
CELLS, OWN = CLASSES * MEMBERS, CLASSES * MEMBERS // 2  # half of the cells hold one word each
ROWS, MEMBER_ROWS = 4096, 1024
ROUNDS, BATCH, RATE = 4, 4096, 0.6
_BLOCK = 6 << 20
_PARTS = 16
_END = 0x5EED  # stands for the end of a text; an endless string of bits like any other word's hash


@dataclass(frozen=True)
class Model:
    frequent: np.ndarray  # hashes of the words with cells of their own, ascending, and their cells
    cells: np.ndarray
    share: np.ndarray  # per cell: count + (different words + 1) / 2
    classes: np.ndarray  # ROWS x CLASSES
    members: np.ndarray  # MEMBER_ROWS * CLASSES x MEMBERS


class _Block:
    """Tokens of some texts: codes into hashes, each text's closed by the end token; and the cell that endings give."""

    def __init__(self, texts: pa.Array):
        words = Words(pc.ascii_lower(texts))
        end = len(words.vocabulary)
        self.hashes = np.append(words.hashes(), np.uint64(_END))
        counts = words.counts
        self.at = np.concatenate([[0], np.cumsum(counts + 1)])
        self.codes = np.full(int(self.at[-1]), end, np.int64)
        self.codes[np.repeat(self.at[:-1], counts) + segments(counts)] = words.codes
        last = words.vocabulary.cast(pa.binary())
        tail = (pc.binary_slice(last, -3, None) if len(last) else last).cast(pa.binary()).dictionary_encode()
        shapes = (text_hashes(tail.dictionary) % np.uint64(CELLS - OWN)).astype(np.int64)
        self.shapes = np.append(shapes[tail.indices.to_numpy(zero_copy_only=False)], 0) + OWN


def _cells(block: _Block, frequent: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cell of each entry of the block's vocabulary."""
    if not len(frequent):
        return block.shapes
    i = np.minimum(np.searchsorted(frequent, block.hashes), len(frequent) - 1)
    return np.where(frequent[i] == block.hashes, cells[i], block.shapes)


def _features(x: np.ndarray, place: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rows of the class table for tokens lo to hi, feature by feature: always, last, one back, two back, last two.

    `place` is each token's place in its text.
    """
    hi = min(hi, len(x))
    token = np.arange(lo, hi)
    before = [np.where(place[lo:hi] >= k, x[np.maximum(0, token - k)], CELLS) for k in (1, 2, 3)]
    room = ROWS - 1 - 3 * (CELLS + 1)
    pair = (mix((before[0] * (CELLS + 1) + before[1]).astype(np.uint64)) % np.uint64(room)).astype(np.int64)
    return np.stack([np.zeros(hi - lo, np.int64), 1 + before[0], 2 + CELLS + before[1], 3 + 2 * CELLS + before[2],
                     1 + 3 * (CELLS + 1) + pair])


_FOLD = np.concatenate([[0], 1 + (mix(np.arange(1, ROWS, dtype=np.uint64)) % np.uint64(MEMBER_ROWS - 1)).astype(np.int64)])


def _odds(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of the table's rows less the greatest of each sum, their exponentials, and the sums of those.

    Maxima are taken by halves and sums by a product, as numpy takes short rows one by one otherwise.
    """
    z = table.take(rows[0], axis=0)
    for r in rows[1:]:
        z += table.take(r, axis=0)
    top = z
    while top.shape[1] > 1:
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    z -= top
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], e.dtype)


def _member_rows(features: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _FOLD[features] * CLASSES + x // MEMBERS


def _log_chance(features: np.ndarray, x: np.ndarray, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The natural logarithm of each cell's probability."""
    each = np.arange(len(x))
    z, _, total = _odds(classes, features)
    w, _, whole = _odds(members, _member_rows(features, x))
    return z[each, x // MEMBERS] - np.log(total) + (w[each, x % MEMBERS] - np.log(whole))


def _step(table: np.ndarray, used: np.ndarray, index: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Moves the rows named by index (feature by feature) by the mean gradient of the tokens that use them.

    Two neighbouring numbers are added as one complex number: numpy sums each column of a segment on its own.
    """
    pairs = gradient.view(np.complex64)
    for ids in index.astype(np.uint16):  # tables are shorter than 2**16 rows, and 16-bit numbers are sorted by radix
        order = np.argsort(ids, kind="stable")
        rows = ids[order]
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        count = np.diff(np.append(heads, len(rows)))
        rows = rows[heads]
        scale = (rate / (count + 4.0)).astype(np.float32)
        table[rows] -= np.add.reduceat(pairs.take(order, axis=0), heads, axis=0).view(np.float32) * scale[:, None]
        used[rows] += count


def learn(blocks_of_cells: Iterator[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, members: np.ndarray, rate: float):
    """Gradient steps over the tokens; returns the new tables and how often each row was used."""
    classes, members = classes.copy(), members.copy()
    used = np.zeros(len(classes)), np.zeros(len(members))
    for x, at in blocks_of_cells:
        place = segments(np.diff(at))
        for lo in range(0, len(x), BATCH):
            f, y = _features(x, place, lo, lo + BATCH), x[lo:lo + BATCH]
            rows, each = _member_rows(f, y), np.arange(len(y))
            for table, index, true, count in ((classes, f, y // MEMBERS, used[0]), (members, rows, y % MEMBERS, used[1])):
                _, e, total = _odds(table, index)
                e /= total[:, None]
                e[each, true] -= 1
                _step(table, count, index, e, rate)
    return classes, members, used


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, n, shape) of every token of the rows (text), the end token included; summed by one shuffle."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", _BLOCK):
            b = _Block(text_of(part, "text"))
            n = np.bincount(b.codes, minlength=len(b.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes.view(np.int64)), pa.array(n), pa.array(b.shapes)], names=["hash", "n", "shape"])

    rows = docs.select("text").mapInArrow(count, "hash bigint, n bigint, shape bigint")
    return rows.groupBy("hash").agg(F.sum("n").alias("n"), F.max("shape").alias("shape"))


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """A model from rows (text) and their word counts. Every document is used in one of the rounds."""
    context = docs.sparkSession.sparkContext
    top = counts.where("n > 0").orderBy(F.col("n").desc(), "hash").limit(OWN).collect()
    order = np.argsort(np.array([r.hash for r in top], np.int64).view(np.uint64), kind="stable")
    frequent = np.array([r.hash for r in top], np.int64).view(np.uint64)[order]
    own = order.astype(np.int64)
    known = F.create_map(*[F.lit(x) for i, r in enumerate(top) for x in (r.hash, i)]) if top else None
    cell = F.coalesce(F.try_element_at(known, F.col("hash")), F.col("shape").cast("int")) if top else F.col("shape").cast("int")
    share, mass = np.full(CELLS, 0.5), np.zeros(CELLS)
    for r in counts.where("n > 0").groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        share[r.cell], mass[r.cell] = r.n + 0.5 * (r.v + 1), r.n
    classes, members = np.zeros((ROWS, CLASSES), np.float32), np.zeros((MEMBER_ROWS * CLASSES, MEMBERS), np.float32)
    mass = mass.reshape(CLASSES, MEMBERS) + 0.5
    classes[0], members[:CLASSES] = np.log(mass.sum(axis=1)), np.log(mass)
    rows = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(ROUNDS)).alias("round"))
    for turn in range(ROUNDS):
        shared = context.broadcast((frequent, own, classes, members))
        rate = RATE * (1 - turn / ROUNDS)

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            frequent, own, classes, members = shared.value

            def read():
                for part in blocks(batches, "text", _BLOCK):
                    b = _Block(text_of(part, "text"))
                    yield _cells(b, frequent, own)[b.codes], b.at

            new, new_members, used = learn(read(), classes, members, rate)
            if used[0][0] == 0:
                return
            flat = np.concatenate([((new - classes) * used[0][:, None]).ravel(), ((new_members - members) * used[1][:, None]).ravel(), *used])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * _PARTS, pa.int32()),
                 pa.array([p.astype("<f4").tobytes() for p in np.array_split(flat, _PARTS)], pa.binary())], names=["part", "task", "data"])

        change = _added(rows.where(F.col("round") == turn).select("text").mapInArrow(gradient, "part int, task int, data binary"))
        if change is None:
            continue
        a, b = classes.size, classes.size + members.size
        used, used_members = change[b:b + ROWS], change[b + ROWS:]
        classes = classes + (change[:a].reshape(classes.shape) / np.maximum(1, used)[:, None]).astype(np.float32)
        members = members + (change[a:b].reshape(members.shape) / np.maximum(1, used_members)[:, None]).astype(np.float32)
    return Model(frequent, own, share, classes, members)


def _added(rows: DataFrame) -> np.ndarray | None:
    """The sum of vectors that tasks give in parts, of one fixed length; added in the order of tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                held[part] = held.get(part, 0) + np.frombuffer(data, "<f4").astype(np.float64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                             names=["part", "data"])

    got = rows.repartition(_PARTS, "part").sortWithinPartitions("part", "task").mapInArrow(add, "part int, data binary").toArrow().to_pylist()
    parts = {r["part"]: np.frombuffer(r["data"], np.float64) for r in got}
    return np.concatenate([parts[i] for i in range(_PARTS)]) if parts else None


def _pack(a: np.ndarray) -> bytes:
    """Integers by planes of bytes, as small ones then leave long runs of zeros to the codecs of files and shuffles."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _rising(a: np.ndarray) -> bytes:
    """Ascending integers, packed as differences."""
    return _pack(np.diff(a, prepend=0).astype("<i8"))


def _answers(known: DataFrame) -> DataFrame:
    """Rows (block, code, n) as few rows (block, codes, times): what one task knows of a block goes together."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, code, n = (b.column(i).to_numpy() for i in range(3))
            order = np.lexsort((code, block))
            block, code, n = block[order], code[order], n[order]
            heads = np.flatnonzero(np.diff(block, prepend=block[:1] - 1))
            ends = [*heads[1:].tolist(), len(block)]
            spans = list(zip(heads.tolist(), ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[heads]), pa.array([_rising(code[lo:hi]) for lo, hi in spans], pa.binary()),
                 pa.array([_pack(n[lo:hi].astype("<i8")) for lo, hi in spans], pa.binary())], names=["block", "codes", "times"])

    return known.select("block", F.col("code").cast("bigint"), "n").sortWithinPartitions("block") \
        .mapInArrow(gather, "block bigint, codes binary, times binary")


def scored(docs: DataFrame, training: Column, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score for every document.

    `training` says which documents to learn from. Tokens are the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then
    one end. base_score: sum of log10((c + 0.5) / (N + 0.5 * (V + 1))); score: the model's log10 probability of the
    text. Null texts are empty and have the end token only; repeated rows are scored alike. Without training documents all
    counts are 0.
    """
    source = docs.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    counts = stored(word_counts(source.where("learn")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    model = train(source.where("learn"), counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(c, source.schema[c].dataType) for c in keep]
    # a block's row holds the hashes of its words, by code; a document's row the codes of its words and how often it has them
    extra = "block bigint, kind int, n_tokens bigint, gain double, hashes array<bigint>, codes binary, times binary"
    schema = T.StructType(fields + T._parse_datatype_string(extra).fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block = shared.value, TaskContext.get().partitionId() << 32
        log_share = np.log10(model.share)
        for part in blocks(batches, "text", _BLOCK):
            b = _Block(text_of(part, "text"))
            x = _cells(b, model.frequent, model.cells)[b.codes]
            place, value = segments(np.diff(b.at)), np.zeros(len(x))
            for lo in range(0, len(x), BATCH):
                value[lo:lo + BATCH] = _log_chance(_features(x, place, lo, lo + BATCH), x[lo:lo + BATCH], model.classes, model.members)
            gain = sums(value / np.log(10) - log_share[x], b.at)
            owner = np.repeat(np.arange(part.num_rows), np.diff(b.at))
            pair, times = np.unique(owner * len(b.hashes) + b.codes, return_counts=True)
            at = np.searchsorted(pair // len(b.hashes), np.arange(part.num_rows + 1)).tolist()
            code = pair % len(b.hashes)
            spans = list(zip(at[:-1], at[1:]))
            none = [pa.nulls(1, f.type) for f in part.schema][:len(keep)]
            names = [*keep, "block", "kind", "n_tokens", "gain", "hashes", "codes", "times"]
            yield pa.RecordBatch.from_arrays([*none, pa.array([block]), pa.array([0], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()),
                                              list_array([b.hashes]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(keep)], pa.array(np.full(part.num_rows, block)), pa.array(np.ones(part.num_rows, np.int32)),
                 pa.array(np.diff(b.at)), pa.array(gain), pa.nulls(part.num_rows, pa.list_(pa.int64())),
                 pa.array([_rising(code[lo:hi]) for lo, hi in spans], pa.binary()),
                 pa.array([_pack(times[lo:hi].astype("<i8")) for lo, hi in spans], pa.binary())], names=names)
            block += 1

    rows = stored(source.select(*keep, "text").mapInArrow(read, schema), "blocks")
    asked = rows.where("kind = 0").select("block", F.posexplode("hashes").alias("code", "hash"))
    known = _answers(asked.join(counts.select("hash", "n"), "hash").select("block", "code", "n")).withColumn("kind", F.lit(0))
    both = known.unionByName(rows.where("kind = 1").drop("hashes"), allowMissingColumns=True)
    both = both.select("block", "kind", "codes", "times", "n_tokens", "gain", *keep, (F.shiftleft("block", 1) + F.col("kind")).alias("__order"))
    least = np.log10(total.n + 0.5 * (total.v + 1))
    made = T.StructType(fields + T._parse_datatype_string(
        "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").fields)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, found = None, np.zeros(0, np.int64)
        for b in batches:
            block, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if block[lo] != here:
                    here, found = block[lo], np.zeros(0, np.int64)
                part = b.slice(lo, hi - lo)
                codes = [np.cumsum(_unpack(c, "<i8")) for c in part.column(2).to_pylist()]
                times = [_unpack(t, "<i8") for t in part.column(3).to_pylist()]
                most = 1 + max(int(c[-1]) for c in codes)
                if most > len(found):
                    found = np.concatenate([found, np.zeros(max(most, 2 * len(found)) - len(found), np.int64)])
                if kind[lo] == 0:
                    found[np.concatenate(codes)] = np.concatenate(times)
                    continue
                size = [len(c) for c in codes]
                at = np.concatenate([[0], np.cumsum(size)])
                c, times = found[np.concatenate(codes)], np.concatenate(times)
                plain = sums(times * np.log10(c + 0.5), at)
                n_tokens = part.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(6 + i) for i in range(len(keep))], pa.array(n_tokens), pa.array(sums(np.where(c > 0, times, 0), at)),
                     pa.array(np.full(len(size), total.n, np.int64)), pa.array(plain - n_tokens * least), pa.array(plain + part.column(5).to_numpy())],
                    names=[f.name for f in made.fields])

    return both.repartition(spread(docs.sparkSession), "block").sortWithinPartitions("__order").mapInArrow(answer, made)
