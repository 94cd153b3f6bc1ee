"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed to rows of a table of vectors, and one row stands for every pair of equal
neighbouring words; a document is the mean of the vectors of all its words, n-grams and such pairs, and a softmax layer reads the label from it. Table and layer are learned by stochastic gradient
descent in numpy on a bounded sample of labelled documents. Since the layer is linear, each row of the table
contributes a fixed amount to the score, which is all that scoring needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakegauge.llm.common import Words, blocks, list_array, map_text, mix, segments, sums, text_of

ROWS, WIDTH, EPOCHS, RATE = 1 << 17, 16, 6, 0.5
GRAMS = (3, 4, 5)  # bytes, the borders of the word included
AGAIN = ROWS  # the row of a word pair that repeats one word
MAX_TRAINING = 4000  # documents; the labelled rows with the least hashes of their ids
THRESHOLD = 0.3
_BLOCK = 4 << 20


@dataclass(frozen=True)
class Model:
    """log-odds of label 1 are `bias` plus the mean of `weight` over a document's features."""
    weight: np.ndarray
    bias: float


def word_features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the table for each word, one after the other, and where each word's begin: the word and its n-grams."""
    words = [b"<" + w + b">" for w in vocabulary.cast(pa.binary()).to_pylist()]
    length = np.array([len(w) for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(data)) - at[owner]
    # a hash of each whole word as a sum of its bytes by place
    powers = mix(np.arange(1, int(length.max(initial=0)) + 1, dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data * powers[place]))])
    hashes, owners = [mix(total[at[1:]] - total[at[:-1]])], [np.arange(len(words))]
    h = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[:len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1:]
        if n in GRAMS:
            inside = place[:len(h)] + n <= length[owner[:len(h)]]
            hashes.append(mix(h[inside] + np.uint64(n)))
            owners.append(owner[:len(h)][inside])
    owners, rows = np.concatenate(owners), (np.concatenate(hashes) & np.uint64(ROWS - 1)).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(words)))])


def _again(words: Words) -> np.ndarray:
    """Per text the words that equal the one before."""
    same = np.zeros(len(words.codes), np.int64)
    same[1:] = words.codes[1:] == words.codes[:-1]
    heads = words.at[:-1][words.counts > 0]
    same[heads] = 0
    return sums(same, words.at)


def _sparse(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its rows and how often each occurs."""
    words = Words(texts)
    rows, at = word_features(words.vocabulary)
    out = []
    for lo, hi, again in zip(words.at[:-1].tolist(), words.at[1:].tolist(), _again(words).tolist()):
        found, times = np.unique(words.codes[lo:hi], return_counts=True)
        size = at[found + 1] - at[found]
        index = np.repeat(at[found], size) + segments(size)
        own, inverse = np.unique(rows[index], return_inverse=True)
        count = np.bincount(inverse, weights=np.repeat(times, size), minlength=len(own))
        out.append((np.append(own, AGAIN)[:len(own) + (again > 0)], np.append(count, again)[:len(own) + (again > 0)].astype(np.float32)))
    return out


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 1) -> Model:
    """Stochastic gradient descent over documents; label 1 against label 0."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (ROWS + 1, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(examples)).tolist():
            rows, times = examples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            share = times / max(1.0, float(times.sum()))
            mean = share @ table[rows] if len(rows) else np.zeros(WIDTH, np.float32)
            raw = mean @ layer + bias
            p = np.exp(raw - raw.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            if len(rows):
                # the mean's gradient, scaled so that a row's step does not shrink with the length of the text
                table[rows] -= rate * np.outer(share * min(len(rows), 100), back)
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
          limit: int = MAX_TRAINING) -> Model:
    """A model from the documents that have a label (0 or 1), at most `limit` of them, chosen by a hash of the id.

    Only ids and labels are sorted for the choice, and the chosen ids, at most `limit`, are sent to the documents. The
    fit runs in one task over them. An id with several labels counts with the least, one with several texts with that of the
    least hash; null ids and labels teach nothing.
    """
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")) \
        .where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    chosen = known.join(rows.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(limit)
    # one text an id, the least by hash, so that the bound holds for rows as well
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(least.alias("least")).select("id", "least.text", "label")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            found = _sparse(text_of(part, "text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), list_array([r for r, _ in found]),
                 list_array([t for _, t in found], pa.float32())], names=["id", "label", "rows", "times"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, known = [], []
        for b in batches:
            for i in range(b.num_rows):
                examples.append((b.column(2)[i].values.to_numpy().astype(np.int32), b.column(3)[i].values.to_numpy().copy()))
                known.append(b.column(1)[i].as_py())
        model = fit(examples, known)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype("<f8").tobytes()]), pa.array([model.bias])], names=["weight", "bias"])

    counted = sample.select("id", "text", "label").mapInArrow(sparse, "id bigint, label int, rows array<bigint>, times array<float>")
    # one document a row, whatever the order the tasks end in
    made = counted.repartition(1).sortWithinPartitions(F.xxhash64("id"), F.size("rows")).mapInArrow(learn, "weight binary, bias double").first()
    if made is None:  # no label at all: every score is 0.5
        return Model(np.zeros(ROWS + 1), 0.0)
    return Model(np.frombuffer(made.weight, "<f8"), made.bias)


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with score (0 to 1, higher: label 1 likelier) and predicted (1 from a score of 0.3 on).

    Null and empty texts have the score of the bias alone. Every word of a text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weight)
    bias = model.bias

    def make():
        weight = shared.value

        def run(texts: pa.Array, _: pa.RecordBatch) -> list:
            words = Words(texts)
            rows, at = word_features(words.vocabulary)
            value, size = sums(weight[rows], at), np.diff(at)
            again = _again(words)
            raw = bias + (sums(value[words.codes], words.at) + again * weight[AGAIN]) / np.maximum(1, sums(size[words.codes], words.at) + again)
            score = 1 / (1 + np.exp(-np.clip(raw, -50, 50)))
            return [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))]
        return run

    return map_text(docs, keep, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, _BLOCK)
