"""Language identification by rank-order profiles.

The most frequent letter n-grams of a language, in order, are its profile. A document is compared with each profile by
the out-of-place distance: how far each of its own most frequent n-grams stands from its place in the profile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lakegauge.llm.common import blocks, map_text, plain, text_of

PROFILE = 400
_BLOCK = 1 << 18  # of text at once: letters, owners and pairs of grams take a hundred times as much
_PAD = 1  # stands for everything that is no letter; below all letters
_FAR = 1 << 22


class _Letters:
    """Code point -> lower-case letter or pad, learned as code points turn up."""

    def __init__(self):
        self.lower = np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.lower[points]
        if len(out) and out.min() < 0:
            for p in np.unique(points[out < 0]).tolist():
                c = chr(p)
                low = c.lower()
                self.lower[p] = (ord(low) if len(low) == 1 and low.isalpha() else p) if c.isalpha() else _PAD
            out = self.lower[points]
        return out


def _block_grams(texts: list[str], letters: _Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram) of every 1-, 2- and 3-gram of letters within words, padded by one blank on both sides.

    Grams are codes into the third array, which holds 64-bit keys: three code points, 0 where there is none. Keys
    ascend, so codes do, and both order grams by length and then by letters.
    """
    joined = "".join(["\n" + t + "\n" for t in texts]).encode("utf-32-le", "surrogatepass")
    points = letters(np.frombuffer(joined, np.uint32))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    seen = np.bincount(points)
    alphabet = np.flatnonzero(seen)
    if not len(alphabet) or alphabet[0] != _PAD:
        alphabet = np.concatenate([[_PAD], alphabet])
    small = np.zeros(max(len(seen), 2), np.int64)
    small[alphabet] = np.arange(len(alphabet))
    x, size = small[points], len(alphabet)
    one = x > 0
    two = (x[:-1] > 0) | (x[1:] > 0)
    three = one[1:-1]
    pair = x[:-1] * size + x[1:]
    codes = np.concatenate([x[one], size + pair[two], size + size * size + (pair[:-1] * size + x[2:])[three]])
    owners = np.concatenate([owner[one], np.where(x[:-1] > 0, owner[:-1], owner[1:])[two], owner[1:-1][three]])
    space = size + size ** 2 + size ** 3
    if space <= _FAR:
        used = np.flatnonzero(np.bincount(codes, minlength=1))
        place = np.zeros(space, np.int32)
        place[used] = np.arange(len(used))
        codes = place[codes]
    else:
        used, codes = np.unique(codes, return_inverse=True)
    keys = np.zeros(len(used), np.int64)
    rest = used.copy()
    first = rest < size
    second = ~first & (rest < size + size ** 2)
    third = ~first & ~second
    keys[first] = alphabet[rest[first]]
    r = rest[second] - size
    keys[second] = alphabet[r // size].astype(np.int64) << 21 | alphabet[r % size]
    r = rest[third] - size - size ** 2
    keys[third] = (alphabet[r // size ** 2].astype(np.int64) << 42 | alphabet[r // size % size].astype(np.int64) << 21
                   | alphabet[r % size])
    return owners, codes, keys


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its `size` most frequent grams, most frequent first; ties by gram.

    Rows without text or language teach nothing. Grams are counted per task and summed by one shuffle over all
    documents; `size` keys per language come to the driver.
    """
    rows = plain(docs, text, lang).toDF("text", "lang").where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _Letters()
        held: dict[str, list] = {}

        def emit(name: str) -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate([k for k, _ in held[name]]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in held[name]])).astype(np.int64)
            del held[name]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(n)],
                                              names=["lang", "gram", "n"])

        for part in blocks(batches, "text", _BLOCK):
            names = part.column(1).to_pylist()
            order = {n: i for i, n in enumerate(dict.fromkeys(names))}
            owners, codes, keys = _block_grams(text_of(part, "text").to_pylist(), letters)
            if not len(keys):
                continue
            which = np.array([order[n] for n in names], np.int64)[owners]
            found, n = np.unique(which * len(keys) + codes, return_counts=True) if len(order) * len(keys) > _FAR \
                else _counted(which * len(keys) + codes)
            for name, i in order.items():
                own = (found // len(keys)) == i
                if own.any():
                    held.setdefault(name, []).append((keys[found[own] % len(keys)], n[own]))
                    if sum(len(k) for k, _ in held[name]) > 1_000_000:
                        yield emit(name)
        for name in list(held):
            yield emit(name)

    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "place", "gram").collect()):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(codes)
    found = np.flatnonzero(n)
    return found, n[found]


def _distances(owners, codes, keys, n_docs: int, ranked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document its number of ranked grams and its distance to each profile. ranked: profile x gram -> place."""
    total, width = len(ranked), max(1, len(keys))
    kept, far = np.zeros(n_docs, np.int64), np.zeros((n_docs, total), np.int64)
    order = np.argsort(owners, kind="stable")
    owners, codes = owners[order], codes[order]
    at = np.searchsorted(owners, np.arange(n_docs + 1))
    step = max(1, (1 << 20) // width)
    down = width - 1 - np.arange(width, dtype=np.int64)
    for lo in range(0, n_docs, step):
        hi = min(n_docs, lo + step)
        own, own_codes = owners[at[lo]:at[hi]].astype(np.int64) - lo, codes[at[lo]:at[hi]]
        n = np.bincount(own * width + own_codes, minlength=(hi - lo) * width).reshape(hi - lo, width)
        value = np.where(n > 0, n * width + down, -1)
        k = min(size, width)
        best = np.argpartition(-value, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (hi - lo, 1))
        value = np.take_along_axis(value, best, axis=1)
        inner = np.argsort(-value, axis=1, kind="stable")
        best, there = np.take_along_axis(best, inner, axis=1), np.take_along_axis(value, inner, axis=1) >= 0
        kept[lo:hi] = there.sum(axis=1)
        place = np.arange(k)
        for p in range(total):
            far[lo:hi, p] = np.where(there, np.minimum(np.abs(ranked[p][best] - place), size), 0).sum(axis=1)
    return kept, far


def identify(docs: DataFrame, known: dict[str, list[int]], keep: list[str], text: str = "text",
             size: int = PROFILE) -> DataFrame:
    """The kept columns with lang_pred and score (0 to 1: how near the nearest profile is).

    A gram that a profile lacks counts `size` places. Ties go to the name that sorts first. A text that is null, empty
    or without a letter is `und` with score 0, as is every text when no profile is known. Texts are compared whole;
    repeated rows give repeated results.
    """
    names = sorted(known)

    def make():
        letters = _Letters()
        table = [(np.sort(np.array(known[n], np.int64)), np.argsort(np.array(known[n], np.int64))) for n in names]

        def run(texts: pa.Array, _: pa.RecordBatch) -> list:
            lines = texts.to_pylist()
            owners, codes, keys = _block_grams(lines, letters)
            ranked = np.full((len(names), max(1, len(keys))), 2 * size, np.int64)
            for p, (ordered, place) in enumerate(table):
                i = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
                hit = ordered[i] == keys
                ranked[p, :len(keys)][hit] = place[i[hit]]
            kept, far = _distances(owners, codes, keys, len(lines), ranked, size)
            if not names:
                return [pa.array(["und"] * len(lines)), pa.array(np.zeros(len(lines)))]
            best = far.argmin(axis=1)
            score = np.where(kept > 0, 1 - far.min(axis=1) / np.maximum(1, kept * size), 0.0)
            return [pa.array([names[b] if k else "und" for b, k in zip(best.tolist(), kept.tolist())], pa.string()),
                    pa.array(score)]
        return run

    return map_text(docs, keep, text, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())],
                    make, _BLOCK)
