"""How filters interact: what each removes, misses and costs under every order in which they can be applied.

A document is a mask of the filters it fails. Under an order it is removed at the first step whose filter is in its mask.
All orders that begin alike are neighbours in lexicographic order, so the orders that remove a mask at one step are
intervals of ranks: one for every beginning of filters outside the mask that ends with one in it. Counts are added where
an interval begins and taken off behind its end; a running sum over the ranks then gives the removals of every order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window, functions as F

from lakegauge.llm.common import stored
from lakegauge.llm.lines import let, words_of

FILTERS = "ABCDE"
_COUNTS = ("removed", "good_lost", "toxic_lost")


def failures(rows: DataFrame, text: str) -> DataFrame:
    """The rows with a column `mask` of the filters that can be told from a whole text alone; bit i is filter i of FILTERS.

    A: under 100 words; B: under 80 per cent of its words distinct; C: over 10 per cent of its code points A to Z; D: one
    of the signs #$%&*|.
    """
    counted = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct")))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    n, distinct = F.col("__words.n"), F.col("__words.distinct")
    fails = {"A": n < 100, "B": distinct * 100 < n * 80, "C": upper * 100 > F.char_length(text).cast("bigint") * 10, "D": F.col(text).rlike("[#$%&*|]")}
    bits = sum((F.when(c, F.lit(1 << FILTERS.index(f))).otherwise(F.lit(0)) for f, c in fails.items()), F.lit(0))
    return rows.withColumn("__words", counted).withColumn("mask", bits).drop("__words")


def masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail just the filters of a mask.

    Bit i of the mask is filter i of FILTERS. E is the filter of copies: a document fails it if a smaller id has the same
    text. Texts are told apart by SHA-256 and never shuffled. A null text is empty, a null part is ''. A null id is
    smaller than none and has none smaller; rows of one id and text are documents of their own, none smaller than another.
    good and toxic count documents with a label row that says so; repeated label rows count once.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), t.alias("text"))
    rows = failures(rows, "text").select("id", "part", "mask", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    marked = labels.select(F.col(f"`{id}`").alias("id"), *[F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]) \
        .groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(marked, "id", "left").withColumn("good", F.coalesce("good", F.lit(0))).withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    # the joined rows lie by id, so copies of a row fold where they are; then those of a text, so a hot text is a row per task
    kind = ["digest", "part", "mask", "good", "toxic"]
    each = rows.groupBy("id", *kind).agg(F.count("*").alias("n"))
    kinds = each.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    first = F.min(F.col("least")["id"]).over(Window.partitionBy("digest"))
    kinds = kinds.withColumn("fresh", F.col("unnamed") + F.when(F.col("least")["id"] == first, F.col("least")["n"]).otherwise(F.lit(0)))
    copy = 1 << FILTERS.index("E")
    both = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("fresh").alias("c")),
                             F.struct((F.col("mask") + copy).alias("m"), (F.col("n") - F.col("fresh")).alias("c")))).alias("x")
    return stored(kinds.select("part", "good", "toxic", both).groupBy("part", F.col("x.m").alias("mask")).agg(
        F.sum("x.c").alias("docs"), F.sum(F.col("x.c") * F.col("good")).alias("good"), F.sum(F.col("x.c") * F.col("toxic")).alias("toxic")), "masks")


def intervals(n: int = len(FILTERS)) -> list[tuple[int, int, int, int, int]]:
    """(mask, step, filter, first, end): the ranks from first up to end of the orders that remove the mask at the step.

    The rank of a beginning is its Lehmer code read in the factorial base: for each place, how many filters that are still
    to come are smaller, times the orders of what follows.
    """
    out = []
    for step in range(1, n + 1):
        for begin in permutations(range(n), step):
            code = [sum(1 for f in range(p) if f not in begin[:i]) for i, p in enumerate(begin)]
            first = sum(c * factorial(n - 1 - i) for i, c in enumerate(code))
            out += [(mask, step, begin[-1], first, first + factorial(n - step)) for mask in range(1 << n)
                    if mask >> begin[-1] & 1 and not any(mask >> f & 1 for f in begin[:-1])]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, zeros included, from the counts of `masks`: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley (the removals of the step's filter, summed over all orders).

    All tables of this step are of fixed size per part: 120 ranks of 5 steps. No part, no rows.
    """
    spark, n = counts.sparkSession, len(FILTERS)
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    spans = F.broadcast(spark.createDataFrame(intervals(n), "mask int, step int, f int, first int, end int"))
    # the difference array: plus where an interval begins, minus behind it
    edges = counts.join(spans, "mask").select("part", "step", F.explode(F.array(
        F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign")))).alias("e"), "docs", "good", "toxic")
    changes = edges.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(
        *[F.sum(F.col("e.sign") * F.col(c)).alias(a) for c, a in zip(("docs", "good", "toxic"), _COUNTS)])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("docs")).otherwise(F.lit(0))).alias(f"fails_{f}") for i, f in enumerate(FILTERS)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("docs")).otherwise(F.lit(0))).alias(f"alone_{f}") for i, f in enumerate(FILTERS)]
    parts = counts.groupBy("part").agg(F.sum("docs").alias("total"), *fails, *alone)
    grid = parts.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n * factorial(n) - 1)))) \
        .withColumn("rank", F.expr(f"cast(cell div {n} as int)")).withColumn("step", F.col("cell") % n + 1) \
        .withColumn("filter_order", F.get(orders, F.col("rank"))).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = grid.join(changes, ["part", "step", "rank"], "left")
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("part", "filter_order", "step", "filter", "total",
                       *[F.element_at(F.create_map(*[x for f in FILTERS for x in (F.lit(f), F.col(f"{k}_{f}"))]), F.col("filter")).alias(k) for k in ("fails", "alone")],
                       *[F.coalesce(F.sum(c).over(running), F.lit(0)).alias(c) for c in _COUNTS])
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return rows.select("part", "filter_order", "step", (F.col("total") - gone).alias("kept"), "removed",
                       (F.col("fails") - F.col("removed")).alias("redundant"), F.col("alone").alias("unique_fails"), "good_lost", "toxic_lost",
                       shapley.alias("shapley"))


# the same in DuckDB, over documents and labels, by walking every order
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
fails AS (
  SELECT rn, part, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
    100 * len(regexp_extract_all(d.text, '[A-Z]')) > 10 * length(d.text) AS fc, regexp_matches(d.text, '[#$%&*|]') AS fd,
    coalesce(doc_id > first, FALSE) AS fe,
    (doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL))::INT AS good, (doc_id IN (SELECT doc_id FROM toxic WHERE doc_id IS NOT NULL))::INT AS toxic
  FROM d LEFT JOIN least ON d.text = least.text),
set_of AS (
  SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END || CASE WHEN fb THEN 'B' ELSE '' END || CASE WHEN fc THEN 'C' ELSE '' END
    || CASE WHEN fd THEN 'D' ELSE '' END || CASE WHEN fe THEN 'E' ELSE '' END) AS failed, good, toxic FROM fails),
grouped AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM set_of GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
walked AS (
  SELECT g.part, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS f,
    sum(CASE WHEN translate(failed, substr(s.filter_order, 1, s.step), '') = failed THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN contains(failed, substr(s.filter_order, s.step, 1)) AND translate(failed, substr(s.filter_order, 1, s.step - 1), '') = failed THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN contains(failed, substr(s.filter_order, s.step, 1)) AND translate(failed, substr(s.filter_order, 1, s.step - 1), '') <> failed THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = substr(s.filter_order, s.step, 1) THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN contains(failed, substr(s.filter_order, s.step, 1)) AND translate(failed, substr(s.filter_order, 1, s.step - 1), '') = failed THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN contains(failed, substr(s.filter_order, s.step, 1)) AND translate(failed, substr(s.filter_order, 1, s.step - 1), '') = failed THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM grouped g, steps s GROUP BY g.part, s.filter_order, s.step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM walked
"""
