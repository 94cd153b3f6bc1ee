"""Secret scan: known shapes by pattern, unknown ones by a battery of randomness tests.

A run of letters and digits whose characters point to an encoding (hex, base32, base62, base64) is tested for what a key
drawn at random would show: a uniform alphabet (chi-squared), as many runs about the middle of the alphabet as chance
gives, and no correlation of neighbours. Each test takes "departs from random by at least a stated amount" as its null
hypothesis, so a small p-value speaks for a random string and short strings, which prove little, have none. The largest
of the three counts. Findings are those that the Benjamini-Hochberg rule admits within their band of lengths, over all
candidates of all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakegauge.llm.common import blocks, map_text, plain, text_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

FALSE_DISCOVERY_RATE = 0.05
BANDS = (20, 28, 40, 64, 128)
_STEPS, _BINS = 20, 400  # p-values are rounded up to twentieths of a power of ten
_MAX_CORRELATION, _MAX_RUNS = 0.5, 0.25

_ENCODINGS = (
    ("hex", re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]+|(?=.*[0-9])(?=.*[A-F])[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+"),
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+"),
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, by start and then by kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, encoding) of the runs that could be a key."""
    out = []
    for m in _RUN.finditer(text):
        for e, (_, shape, _) in enumerate(_ENCODINGS):
            if shape.fullmatch(m[0]):
                out.append((m.start(), m.end(), e))
                break
    return out


def _below(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z.tolist()])


def p_values(tokens: list[str], encodings: list[int]) -> np.ndarray:
    """The largest p-value of the three tests per token; near 0 for a random one that is long enough."""
    out = np.ones(len(tokens))
    for e, (_, _, alphabet) in enumerate(_ENCODINGS):
        own = [i for i, x in enumerate(encodings) if x == e]
        if not own:
            continue
        size = len(alphabet)
        place = np.full(128, size - 1, np.int64)
        for i, c in enumerate(alphabet):
            place[ord(c)] = i
        if e == 0:
            place[ord("A"):ord("G")] = np.arange(10, 16)
        else:
            place[ord("-")], place[ord("_")] = (62, 63) if size == 64 else (size - 1, size - 1)
        length = np.array([len(tokens[i]) for i in own])
        x = place[np.frombuffer("".join(tokens[i] for i in own).encode(), np.uint8)]
        owner = np.repeat(np.arange(len(own)), length)
        n = length.astype(float)
        seen = np.bincount(owner * size + x, minlength=len(own) * size).reshape(len(own), size)
        chi = ((seen - n[:, None] / size) ** 2).sum(axis=1) * size / n
        # words and numbers written in this alphabet lie at least this far from uniform
        away = n * max(0.7, 0.055 * size - 1)
        freedom = size - 1
        scale = (freedom + 2 * away) / (freedom + away)
        f = (freedom + away) ** 2 / (freedom + 2 * away)
        uniform = _below(((chi / (scale * f)) ** (1 / 3) - (1 - 2 / (9 * f))) / np.sqrt(2 / (9 * f)))
        inner = owner[1:] == owner[:-1]
        high = x >= size / 2
        turns = np.bincount(owner[1:][inner & (high[1:] != high[:-1])], minlength=len(own))
        runs = _below((np.abs(turns / (n - 1) - 0.5) - _MAX_RUNS) * np.sqrt(n - 1) * 2)
        total, squares = np.bincount(owner, weights=x), np.bincount(owner, weights=x * x)
        mean = total / n
        apart = (x - mean[owner]).astype(float)
        products = np.bincount(owner[1:][inner], weights=(apart[1:] * apart[:-1])[inner], minlength=len(own))
        spread = np.maximum(squares - n * mean ** 2, 1e-9)
        serial = _below((np.abs(products / spread) - _MAX_CORRELATION) * np.sqrt(n))
        out[own] = np.maximum(np.maximum(uniform, runs), serial)
    return out


def _binned(p: np.ndarray) -> np.ndarray:
    return np.minimum(_BINS, np.floor(-np.log10(np.maximum(p, 1e-300)) * _STEPS)).astype(np.int64)


def _band(lengths: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, lengths, side="right") - 1


def admitted(docs: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> list[int]:
    """Per band of lengths the least bin of p-values that the Benjamini-Hochberg rule admits.

    All candidates of all documents count; a few hundred sums per task are shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(BANDS), _BINS + 1), np.int64)
        for part in blocks(batches, "text"):
            tokens, encodings = [], []
            for t in text_of(part, "text").to_pylist():
                for a, b, e in candidates(t):
                    tokens.append(t[a:b])
                    encodings.append(e)
            if tokens:
                np.add.at(total, (_band(np.array([len(t) for t in tokens])), _binned(p_values(tokens, encodings))), 1)
        band, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(band.astype(np.int32)), pa.array(place.astype(np.int32)),
                                          pa.array(total[band, place])], names=["band", "bin", "n"])

    rows = plain(docs, text).toDF("text").mapInArrow(count, "band int, bin int, n bigint").groupBy("band", "bin").agg(F.sum("n").alias("n"))
    total = np.zeros((len(BANDS), _BINS + 1))
    for r in rows.collect():
        total[r.band, r.bin] += r.n
    least = []
    for band in total:
        within = band[::-1].cumsum()[::-1]  # candidates at or below each p-value
        good = np.flatnonzero((within > 0) & (10.0 ** (-np.arange(_BINS + 1) / _STEPS) * band.sum() <= rate * within))
        least.append(int(good[0]) if len(good) else _BINS + 1)
    return least


def all_spans(texts: list[str], least: list[int]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) per text: the known shapes, then admitted random strings that touch none of them."""
    out, tokens, encodings, places = [], [], [], []
    for i, t in enumerate(texts):
        out.append(base_spans(t))
        for a, b, e in candidates(t):
            if not any(a < end and start < b for start, _, end in out[i]):
                tokens.append(t[a:b])
                encodings.append(e)
                places.append((i, a, b))
    if tokens:
        good = _binned(p_values(tokens, encodings)) >= np.array(least)[_band(np.array([len(t) for t in tokens]))]
        for (i, a, b), g in zip(places, good.tolist()):
            if g:
                out[i].append((a, 3, b))
    return [sorted(s) for s in out]


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def scan(docs: DataFrame, keep: list[str], text: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """The kept columns and `spans`: kind, start and end (code points, end exclusive), by start and then by kind.

    Null and empty texts have no spans. Texts are read whole, twice: once to count p-values, once to mark.
    """
    least = admitted(docs, text, rate)

    def make():
        def run(texts: pa.Array, _: pa.RecordBatch) -> list:
            return [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in all_spans(texts.to_pylist(), least)],
                             pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
        return run

    return map_text(docs, keep, text, [T.StructField("spans", T.ArrayType(_SPAN))], make)


def redacted(docs: DataFrame, text: str = "text", mark: str = "<secret>", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """The documents, all columns, with every span that `scan` finds replaced by `mark`; overlapping spans are one.

    Null texts stay null.
    """
    least = admitted(docs, text, rate)
    keep = docs.columns

    def make():
        def run(texts: pa.Array, part: pa.RecordBatch) -> list:
            lines = texts.to_pylist()
            there = part.column(keep.index(text)).is_valid().to_pylist()
            out = []
            for t, spans, known in zip(lines, all_spans(lines, least), there):
                pieces, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        pieces += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join(pieces) + t[at:] if known else None)
            return [pa.array(out, pa.string())]
        return run

    made = map_text(docs, keep, text, [T.StructField("__clean", T.StringType())], make)
    return made.select(*[F.col("__clean" if c == text else f"`{c}`").alias(c) for c in docs.columns])
