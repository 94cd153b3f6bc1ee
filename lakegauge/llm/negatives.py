"""Hard negatives by a vertical scan of vectors kept in columns.

Rows and anchors are dealt to blocks, and each pair of a block of rows and a block of anchors is one group of bounded
size. In a group every anchor reads the columns in order of its own falling magnitudes. What the columns not yet read
can add to a row's score lies between sums of their least and greatest products; rows whose score cannot come into
question leave the candidates, and what remains after the last column has exact scores.

The scan runs twice: for the positives, which are the highest scores of the anchor's label, and then for the windows
below them, in which the highest scores of other labels are the negatives.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakegauge.llm.common import plain, stored

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # per cent of a positive's score between which a negative's lies
_ROWS, _ANCHORS = 8192, 2048  # per block
_STEP = 8  # columns read at a time
_LARGE = 1 << 28  # components from here on could overflow a sum of 64 bits


def scaled(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, id, label, asks, v): the rows that take part, with components floor(256 x) as whole numbers.

    Left out are rows with a null id, label or vector, with a null or non-finite component, or with a component of 2**20 or
    more, whose products could exceed 64 bits. Rows with one id are rows of their own.
    """
    x = F.transform(F.col(f"`{vector}`"), lambda e: F.floor(e.cast("double") * 256))
    good = F.col(f"`{id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.coalesce(F.forall(
        f"`{vector}`", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * 256 < _LARGE)), F.lit(False))
    return rows.where(good).select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").cast("bigint").alias("id"),
                                   F.col(f"`{label}`").cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), x.alias("v"))


# --- one group: a block of rows in columns, and anchors -----------------------------------------------------------

def columns_of(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as an array of dims columns; a shorter vector ends in zeros. Doubles hold its whole numbers exactly."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * dims:
        return np.ascontiguousarray(flat.reshape(len(sizes), dims).T)
    out = np.zeros((dims, len(sizes)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    return out


class Block:
    """Rows in columns, with the least and the greatest value of each column."""

    def __init__(self, columns: np.ndarray):
        self.columns = columns
        n = columns.shape[1]
        self.low = columns.min(axis=1) if n else np.zeros(len(columns))
        self.high = columns.max(axis=1) if n else np.zeros(len(columns))
        greatest = np.abs(columns).max(initial=0)
        self.exact = lambda anchor: float(np.abs(anchor).max(initial=0)) * greatest * max(1, len(columns)) < 2 ** 53

    def scan(self, anchor: np.ndarray, alive: np.ndarray, dead: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of `alive` that `dead` never dismissed, and their exact scores.

        `dead` is given the least and greatest scores that each remaining row can still have.
        """
        columns = self.columns
        if not self.exact(anchor):
            columns, anchor = columns.astype(np.int64), anchor.astype(np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort(np.stack([anchor * self.low.astype(anchor.dtype), anchor * self.high.astype(anchor.dtype)]), axis=0)[:, order]
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), ends.dtype)], axis=1)
        score = np.zeros(len(alive), anchor.dtype)
        for at in range(0, len(order), _STEP):
            for d in order[at:at + _STEP].tolist():
                column = columns[d]
                score += anchor[d] * (column[alive] if len(alive) < len(column) else column)
            to = min(at + _STEP, len(order))
            gone = dead(score + rest[0, to], score + rest[1, to])
            if gone.any():
                alive, score = alive[~gone], score[~gone]
                if not len(alive):
                    break
        return alive, score.astype(np.int64)


def nth_highest(values: np.ndarray, n: int) -> float:
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def best(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by id."""
    return np.lexsort((ids, -score))[:n]


def positives_in(block: Block, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, uid: int, label: int,
                 n: int = POSITIVES) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the anchor's highest n rows of its label in the block, itself left out."""
    mine = np.flatnonzero((labels == label) & (uids != uid))
    alive, score = block.scan(anchor, mine, lambda low, high: high < nth_highest(low, n))
    top = best(score, ids[alive], n)
    return alive[top], score[top]


def limits(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score of a negative of each positive, as whole numbers."""
    return -((-LEAST * positive) // 100), (MOST * positive) // 100


def negatives_in(block: Block, ids: np.ndarray, labels: np.ndarray, anchor: np.ndarray, label: int, positive: np.ndarray,
                 n: int = NEGATIVES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score, places and scores of the highest n rows of other labels within its window in the block."""
    least, most = limits(positive)

    def dead(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.ones(len(low), bool)
        for a, b in zip(least.tolist(), most.tolist()):
            sure = low[(low >= a) & (high <= b)]
            out &= (high < max(a, nth_highest(sure, n))) | (low > b)
        return out

    alive, score = block.scan(anchor, np.flatnonzero(labels != label), dead)
    out = []
    for a, b in zip(least.tolist(), most.tolist()):
        there = np.flatnonzero((score >= a) & (score <= b))
        top = there[best(score[there], ids[alive[there]], n)]
        out.append((alive[top], score[top]))
    return out


# --- all groups ------------------------------------------------------------------------------------------------

def _scan_groups(rows: DataFrame, anchors: DataFrame, dims: int, sizes: tuple[int, int], schema: str, ask: Callable) -> DataFrame:
    """`ask` for every anchor of every pair of a block of rows and a block of anchors; the parts of its answers as rows.

    Blocks are dealt by a hash of the row's own number, so that equal rows, ids or labels do not meet in one block.
    """
    parts, sets = (max(1, -(-n // size)) for n, size in zip(sizes, (_ROWS, _ANCHORS)))

    def numbers(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    rows, anchors = plain(rows, *rows.columns), plain(anchors, *anchors.columns)
    left = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts))).withColumn("set", numbers(sets))
    right = anchors.withColumn("set", F.pmod(F.xxhash64(F.lit(1), "uid"), F.lit(sets))).withColumn("part", numbers(parts))

    def group(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = rows.combine_chunks(), anchors.combine_chunks()
        one = lambda t, c: t.column(c).to_numpy()
        block = Block(columns_of(_array(rows.column("v")), dims))
        vectors = columns_of(_array(anchors.column("v")), dims).T
        extra = anchors.column("scores").to_pylist() if "scores" in anchors.column_names else [None] * len(anchors)
        return ask(block, one(rows, "id"), one(rows, "uid"), one(rows, "label"),
                   zip(one(anchors, "uid").tolist(), one(anchors, "id").tolist(), one(anchors, "label").tolist(), vectors, extra))

    return left.groupBy("part", "set").cogroup(right.groupBy("part", "set")).applyInArrow(group, schema)


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def mined(rows: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: up to three negatives of each of the
    first five positives of every row for which `anchor` holds.

    Scores are whole inner products, ties go to the smaller id. Rows of `scaled` take part; a shorter vector ends in
    zeros. A repeated row is another row: it can be a positive of its twin. Anchors without a positive, or whose windows
    hold no row, have no row; an empty table gives an empty one. A null condition is false.
    """
    table = stored(scaled(rows, anchor, id, vector, label), "vectors")
    n, asked, dims = table.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    sizes, dims, anchors = (n, asked), dims or 0, table.where("asks").drop("asks")
    table = table.drop("asks")

    def ask_positives(block, ids, uids, labels, anchors):
        out = []
        for uid, a, own, v, _ in anchors:
            places, score = positives_in(block, ids, uids, labels, v, uid, own)
            out += [(uid, a, p, s) for p, s in zip(ids[places].tolist(), score.tolist())]
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["uid", "anchor_id", "positive_id", "positive_score"])

    found = _scan_groups(table, anchors, dims, sizes, "uid bigint, anchor_id bigint, positive_id bigint, positive_score bigint", ask_positives)
    first = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id")
    positives = stored(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES), "positives")

    windows = positives.groupBy("uid").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))  # five at most
    asking = anchors.join(windows, "uid")

    def ask_negatives(block, ids, uids, labels, anchors):
        out = []
        for uid, _, own, v, scores in anchors:
            for s, (places, score) in zip(scores, negatives_in(block, ids, labels, v, own, np.array(scores, np.int64))):
                out += [(uid, s, i, x) for i, x in zip(ids[places].tolist(), score.tolist())]
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["uid", "positive_score", "negative_id", "negative_score"])

    found = _scan_groups(table, asking, dims, sizes, "uid bigint, positive_score bigint, negative_id bigint, negative_score bigint", ask_negatives)
    first = Window.partitionBy("uid", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES)
    return positives.join(negatives, ["uid", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


# the same in DuckDB over the table embeddings, with every score of every anchor
SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c AS (SELECT rn, vec_id, label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e),
s AS (
  SELECT a.rn AS ar, b.rn AS br, any_value(a.vec_id) AS anchor_id, any_value(b.vec_id) AS other_id, any_value(a.label) AS al,
    any_value(b.label) AS bl, sum(a.x * b.x)::BIGINT AS score
  FROM c a JOIN c b ON a.i = b.i WHERE a.vec_id % 50 = 0 AND a.rn <> b.rn GROUP BY a.rn, b.rn),
p AS (SELECT ar, anchor_id, br, other_id AS positive_id, score AS ps FROM s WHERE al = bl
      QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, other_id AS negative_id, ps, score,
        row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, other_id) AS rank
      FROM p JOIN s ON s.ar = p.ar AND al <> bl AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 3
"""
