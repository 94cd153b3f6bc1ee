"""SimHash fingerprints, and the search for all fingerprints within a Hamming radius by permuted block tables.

Everything is DataFrame expressions; nothing runs in Python.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakegauge.llm.common import spread, stored
from lakegauge.llm.lines import let, words_of

BITS, RADIUS, BLOCKS = 64, 3, 6
_MAX_WEIGHT = 15
_LANES, _LANE = 16, 0x0001000100010001  # four 16-bit counters in one 64-bit sum
_RANGES = 8  # ranges of ids for each task
_CHUNK = 11  # 2**11 terms of weight 15 at most stay below 2**15, so the uppermost counter keeps clear of the sign


def votes(rows: DataFrame, text: str, *keys: str, **kept: Column) -> DataFrame:
    """keys, kept columns and `fingerprint` for every row, 0 for one without a term.

    Terms are neighbouring words, a single one at the end of a text; each votes on 64 signs with its hash, weighted by
    its length in letters up to 15, as long terms are rarer. Four counters share a 64-bit sum, so a term costs sixteen
    additions; sums of 2048 terms are unpacked before they are added up. They combine where the text is read: what is
    shuffled is one row per 2048 terms. Kept columns are numbers, of which the greatest is taken.
    """
    terms = let(words_of(F.col(text)), lambda w: F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))
    each = rows.select(*keys, *[c.alias(n) for n, c in kept.items()], F.posexplode_outer(terms).alias("place", "term"))
    each = each.select(*keys, *kept, F.shiftright("place", _CHUNK).alias("chunk"), F.xxhash64("term").alias("h"),
                       F.when(F.col("term").isNotNull(), F.least(F.char_length("term"), F.lit(_MAX_WEIGHT))).cast("bigint").alias("weight"))
    most = [F.max(n).alias(n) for n in kept]
    packed = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANE)) * F.col("weight")).alias(f"s{j}") for j in range(_LANES)]
    sums = each.groupBy(*keys, "chunk").agg(*most, F.sum("weight").alias("total"), *packed)
    lanes = [F.sum(F.shiftrightunsigned(f"s{b % _LANES}", b // _LANES * 16).bitwiseAND(F.lit(0xFFFF))).alias(f"b{b}") for b in range(BITS)]
    whole = sums.groupBy(*keys).agg(*most, F.sum("total").alias("total"), *lanes)
    mark = None
    for b in range(BITS):
        bit = F.when(F.col(f"b{b}") * 2 > F.col("total"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint")
        mark = bit if mark is None else mark.bitwiseOR(bit)
    return whole.select(*keys, *kept, mark.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def as_number(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("bigint")


def ranged(rows: DataFrame, id: str, tie: str) -> DataFrame:
    """The rows dealt to ranges of (id, tie): `part` tells the range, and behind its last row stands a copy of the first row
    of the next range (`copy` is 1), for the last range that of the first.

    So whatever a row needs of the one that follows it lies in its range, and an id of many rows takes several. Rows with
    a null id have ranges of their own and are followed by none. Ids are numbers, ties hashes of 64 bits. Only the cut
    points and the first (id, tie) of each range reach the driver; ranges are several times as many as tasks, so that
    tasks are alike in size.
    """
    parts = _RANGES * max(2, spread(rows.sparkSession))
    seen = rows.select(F.percentile_approx(id, [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    cuts = [(v, (j << 64) // (n + 1) - (1 << 63)) for v, n in sorted(Counter(seen).items()) for j in range(n)]
    pair, known = F.struct(F.col(id).alias("i"), F.col(tie).alias("t")), F.col(id).isNotNull()
    width = max(1, math.isqrt(len(cuts)))

    def points(some: list[tuple]) -> Column:
        return F.array(*[F.struct(F.lit(v).cast(rows.schema[id].dataType).alias("i"), F.lit(t).cast("bigint").alias("t")) for v, t in some])

    def behind(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c <= pair))

    above = F.lit(0)
    if cuts:  # two steps of about a square root of all cut points each
        above = behind(points(cuts[width - 1::width])) * width
        above = let(above, lambda done: done + behind(F.slice(points(cuts), done + 1, F.lit(width))))
    dealt = rows.withColumn("part", F.when(known, above).otherwise(len(cuts) + 1 + F.pmod(F.hash(tie), F.lit(parts)))).withColumn("copy", F.lit(0))
    least = sorted((r["part"], *r["m"]) for r in dealt.where(known).groupBy("part").agg(F.min(pair).alias("m")).collect())
    if not least:
        return dealt
    marks = rows.sparkSession.createDataFrame([(v, t, least[i - 1][0]) for i, (_, v, t) in enumerate(least)], T.StructType([
        rows.schema[id], rows.schema[tie], T.StructField("part", T.IntegerType())]))  # one row per range
    others = [c for c in rows.columns if c not in (id, tie)]
    first = rows.join(F.broadcast(marks), [id, tie]).groupBy(id, tie, "part").agg(*[F.first(c).alias(c) for c in others])
    return dealt.unionByName(first.withColumn("copy", F.lit(1)))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hex digits), near_edited,
    near_next (1 - distance / 64).

    In the edited text the last quarter (rounded down) of the code points is replaced by the first as many, or all, of the
    next document's. Null texts are empty; a text without a word has fingerprint 0, and equal texts have equal
    fingerprints. Repeated rows are rows of their own and follow each other. Without a next document nothing takes the
    quarter's place and near_next is 0. Texts are read whole and shuffled once, to their ranges of ids; hash of the
    edited text and votes of both are made there in one pass.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("part").orderBy("copy", "id", "tie")
    laid = ranged(rows.withColumn("tie", F.xxhash64("text")), "id", "tie").select(
        "part", "copy", "id", "text", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("after"))
    known = F.col("id").isNotNull()
    laid = laid.withColumn("n_chars", F.char_length("text")).withColumn("cut", F.expr("n_chars div 4").cast("int"))
    edited = F.concat(F.expr("left(text, n_chars - cut)"), F.when(known, F.expr("left(coalesce(after, ''), cut)")).otherwise(""))
    laid = laid.select("part", "row", "copy", "id", "n_chars", "text", edited.alias("edited"))
    words = [F.conv(F.substring("sha", i * 16 + 1, 16), 16, -10).cast("bigint") for i in range(4)]
    sides = laid.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).select(
        "part", "row", "copy", "id", "n_chars", *[w.alias(f"w{i}") for i, w in enumerate(words)], F.posexplode(F.array("text", "edited")).alias("side", "t"))
    kept = {n: F.col(n) for n in ("copy", "id", "n_chars", "w0", "w1", "w2", "w3")}
    marks = votes(sides.where("side = 0 or copy = 0"), "t", "part", "row", "side", **kept)
    whole = marks.groupBy("part", "row").agg(*[F.max(n).alias(n) for n in kept], F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("own"),
                                             F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("changed"))
    whole = whole.withColumn("next", F.when(known, F.lead("own").over(Window.partitionBy("part").orderBy("row")))).where("copy = 0")
    return stored(whole.select(
        F.col("id").alias(id), F.col("n_chars").cast("bigint").alias("n_chars"), F.concat(*[as_text(F.col(f"w{i}")) for i in range(4)]).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), F.coalesce(likeness(F.col("own"), F.col("next")), F.lit(0.0)).alias("near_next")), "marks")


def tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Masks of the permuted tables: fingerprints within the radius agree on all but `radius` of the blocks, so on one
    choice of `blocks - radius` of them at least."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within(queries: DataFrame, stock: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found, distance): every fingerprint of the stock within the radius of each query's.

    Both sides are one column of 64-bit fingerprints; equal ones are one, nulls are left out. With 6 blocks and radius 3
    a table's key has about 32 bits, so that strangers seldom meet whatever the size of the stock. A pair that meets in
    several tables counts in the first of them.
    """
    masks = tables(radius, blocks)

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col(rows.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct()
        return rows.select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))

    apart = F.col("query").bitwiseXOR(F.col("found"))
    first = F.least(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    met = dealt(queries, "query").join(dealt(stock, "found"), ["table", "key"])
    return met.where((F.bit_count(apart) <= radius) & (first == F.col("table"))).select("query", "found", F.bit_count(apart).alias("distance"))
