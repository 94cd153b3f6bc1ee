"""Packing of documents into training sequences: cutting stock by column generation.

Documents are cut at multiples of the sequence length, which leaves full pieces and one remainder each. The histogram of
piece lengths, of a fixed number of classes, is all that the plan needs: a linear program over patterns (how many pieces
of which class share a sequence), whose columns a knapsack finds by its prices, rounded down, the few pieces left over
packed best-fit. Pieces are ranked within their class, and a piece's rank says its pattern, sequence and slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lakegauge.llm.common import map_text, plain, segments, small_batches, spread, stored
from lakegauge.llm.wordtokens import word_tokens

LENGTH = 4096
END = 2
UNIT = 8  # lengths are planned in classes this wide: the linear program has LENGTH / UNIT rows whatever the data
_GAP = 1e-3
_ROUNDS = 600
_BATCH = 500  # rows
_BLOCK = 1 << 20  # of text at once: ids, places and words of a block take thirty times as much


def pieces(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, length: int = LENGTH,
           end: int = END) -> DataFrame:
    """The kept columns with start, length, ids_crc32 and doc_tokens for every piece of every document.

    A document's ids are those of its whole text and then `end`; a null or empty text has that one id.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    fields = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "lengths", "crcs")]

    def make():
        tokens = word_tokens(path)

        def run(texts: pa.Array, _: pa.RecordBatch) -> list:
            ids, at = tokens.encode(texts)
            ids = np.insert(ids.astype("<u4"), at[1:], end)
            size = np.diff(at) + 1
            at = at + np.arange(len(at))
            count = -(-size // length)
            starts = segments(count) * length
            lengths = np.minimum(length, np.repeat(size, count) - starts)
            first = np.repeat(at[:-1], count) + starts
            crcs = np.array([zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + lengths).tolist())], np.int64)
            rows = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            return [pa.ListArray.from_arrays(rows, pa.array(v)) for v in (starts, lengths, crcs)]
        return run

    cut = map_text(docs, keep, text, fields, make, _BLOCK)
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b)
    rows = cut.withColumn("doc_tokens", total).select(
        *keep, "doc_tokens", F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"),
                                                   F.col("crcs").alias("ids_crc32"))))
    return rows.select(*keep, "start", "length", "ids_crc32", "doc_tokens")


# --- the plan ------------------------------------------------------------------------------------------------

@dataclass
class Plan:
    """For each class, ranks from `first[i]` on go to sequences `base[i]`, ..., `each[i]` pieces apiece, from `slot[i]` on."""
    first: dict[int, list[int]] = field(default_factory=dict)
    each: dict[int, list[int]] = field(default_factory=dict)
    base: dict[int, list[int]] = field(default_factory=dict)
    slot: dict[int, list[int]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)
    sequences: int = 0

    def add(self, pattern: dict[int, int], copies: int) -> None:
        slot = 0
        for size, n in sorted(pattern.items(), reverse=True):
            for held, value in ((self.first, self.used.get(size, 0)), (self.each, n), (self.base, self.sequences), (self.slot, slot)):
                held.setdefault(size, []).append(value)
            self.used[size] = self.used.get(size, 0) + n * copies
            slot += n
        self.sequences += copies


def knapsack(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest pattern: best sum of prices of pieces that fit into the room, and how many of each."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    good = np.flatnonzero(prices > 1e-12)
    sizes_good, prices_good = sizes[good], prices[good]
    for c in range(1, room + 1):
        best[c], last[c] = best[c - 1], -1
        k = np.searchsorted(sizes_good, c, side="right")
        if k:
            value = prices_good[:k] + best[c - sizes_good[:k]]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], last[c] = value[i], good[i]
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[room]), counts


def first_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """One pattern per size, and how often: led by that size, which it uses up, and filled with the largest smaller ones
    of which enough is left. Ordered by size, the patterns are a triangular matrix, so they are a basis."""
    left = demand.copy()
    columns, used = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    for i in range(len(sizes) - 1, -1, -1):
        n = room // sizes[i]
        columns[i, i], free = n, room - n * sizes[i]
        used[i] = left[i] / n
        left[i] = 0
        j = i - 1
        while free and j >= 0 and used[i] > 0:
            j = min(j, int(np.searchsorted(sizes, free, side="right")) - 1)
            fits = np.flatnonzero(left[:j + 1] >= used[i])
            if not len(fits):
                break
            j = int(fits[-1])
            columns[i, j] += 1
            left[j] -= used[i]
            free -= int(sizes[j])
    return columns, used


def inverted(columns: np.ndarray) -> np.ndarray:
    """The inverse of the transposed patterns, by substitution from the largest size down.

    A pattern has few sizes, so this is a few row operations per size. No BLAS and no LAPACK: their threads can hang in a
    driver that has started a JVM.
    """
    out = np.zeros(columns.shape)
    for i in range(len(columns) - 1, -1, -1):
        row = np.zeros(len(columns))
        row[i] = 1
        for p in (np.flatnonzero(columns[i + 1:, i]) + i + 1).tolist():
            row -= columns[p, i] * out[p]
        out[i] = row / columns[i, i]
    return out


def relaxed(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often each is used, fractions included, close to the least number of sequences."""
    columns, used = first_patterns(sizes, demand, room)  # row p: pattern p
    inverse = inverted(columns)
    for _ in range(_ROUNDS):
        prices = inverse.sum(axis=0)
        value, counts = knapsack(prices, sizes, room)
        if value <= 1 + _GAP:  # no plan has fewer than used.sum() / value sequences
            break
        held = np.flatnonzero(counts)
        direction = (inverse[:, held] * counts[held]).sum(axis=1)
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        used = np.maximum(0, used - step * direction)
        used[leaving] = step
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        columns[leaving] = counts
    return columns.astype(np.int64), used


def best_fit(sizes: list[int], room: int) -> list[dict[int, int]]:
    """Sequences for a few pieces, largest first, each into the fullest sequence that still has room."""
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    out: list[dict[int, int]] = []
    for size in sorted(sizes, reverse=True):
        free = next((r for r in range(size, room + 1) if by_room[r]), None)
        if free is None:
            out.append({})
            i, free = len(out) - 1, room
        else:
            i = by_room[free].pop()
        out[i][size] = out[i].get(size, 0) + 1
        by_room[free - size].append(i)
    return out


def plan(histogram: dict[int, int], room: int) -> Plan:
    """histogram: class size -> number of pieces."""
    made, left = Plan(), dict(histogram)
    sizes = np.array(sorted(left), np.int64)
    if len(sizes):
        patterns, used = relaxed(sizes, np.array([left[s] for s in sizes.tolist()], float), room)
        for counts, copies in zip(patterns, np.floor(used + 1e-7).astype(np.int64).tolist()):
            pattern = {int(sizes[i]): int(counts[i]) for i in np.flatnonzero(counts)}
            copies = min([copies, *(left[s] // n for s, n in pattern.items())])
            if copies > 0:
                made.add(pattern, copies)
                for s, n in pattern.items():
                    left[s] -= n * copies
        for pattern in best_fit([s for s, n in left.items() for _ in range(n)], room):
            made.add(pattern, 1)
    return made


def packed(rows: DataFrame, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset; every row is placed, offsets of a sequence have no gap.

    Only sums by class of length reach the driver. Ranks are given within (class, salt), so that a third of all pieces
    with one length is no task of its own. An empty table gives an empty one.
    """
    names = rows.columns
    salts = spread(rows.sparkSession)
    size = F.ceil(F.col("length") / unit).cast("bigint")
    with small_batches(rows.sparkSession, _BATCH):
        rows = stored(rows.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn("__size", size).withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.lit(salts)))
    counts = rows.groupBy("__size", "__salt").agg(F.count("*").alias("__n"))
    histogram = {r["__size"]: r["n"] for r in counts.groupBy("__size").agg(F.sum("__n").alias("n")).collect()}
    made = plan(histogram, length // unit)
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__size", "__salt", before.alias("__before"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__size", "__salt").orderBy("__uid")) - 1) \
        .join(offsets, ["__size", "__salt"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    ranked = plain(ranked, *names, "__size", "__rank")
    tables = {s: tuple(np.array(t[s]) for t in (made.first, made.each, made.base, made.slot)) for s in made.first}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ranks = (b.column(len(names) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sequence, slot = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes).tolist():
                own = sizes == s
                first, each, base, at = tables[s]
                i = np.searchsorted(first, ranks[own], side="right") - 1
                inner = ranks[own] - first[i]
                sequence[own], slot[own] = base[i] + inner // each[i], at[i] + inner % each[i]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [pa.array(sequence), pa.array(slot)],
                                             names=[*names, "sequence_id", "__slot"])

    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("__slot", T.LongType())])
    placed = ranked.mapInArrow(place, schema)
    ahead = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select(*names, "sequence_id", "offset")
