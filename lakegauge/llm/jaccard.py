"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word n-grams. Equal sets are one set. Each set keeps a signature: its first tokens in an order that
all sets share, rare tokens before frequent ones, long enough that two sets above the threshold have a stated number of
signature tokens in common. Sets with the same least token of usual frequency form a group, and the matrix (token, group)
holds the union of each group's signatures. A set is compared with members of a group only if enough of its signature lies in
that union. Groups are opened leader first: who links to the leader is in its component and need not be compared with
the other members of that component. What is compared is the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakegauge.llm.common import (Words, blocks, bloom, grams, id_hashes, in_bloom, list_array, map_text, mix, plain, stored,
                                  text_of)
from lakegauge.llm.components import merged
from lakegauge.llm.lines import let

SKETCH_BITS = 22
_PARTS = 64
_BLOCK = 1 << 20  # of text at once: its shingles take twenty times as much
_OPEN_PAIRS = 8  # at first, groups are opened whole that hold no more pairs than this for each member and query
_SPACING = 20
_STEPS = 16  # places kept of a set's missing tokens


def need(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a linked one."""
    return -(-percent * n // 100)


def signature_size(n: int, percent: int) -> int:
    """What a linked set may lack, and as many more tokens as linked sets then have in common there."""
    return n - need(n, percent) + 1 + n // _SPACING


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text its distinct word n-grams as ascending 64-bit hashes; a shorter text is one n-gram."""
    words = Words(pc.ascii_lower(texts))
    hashes = words.hashes()[words.codes]
    whole = grams(hashes, width)
    for lo, hi in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        if hi - lo >= width:
            yield np.unique(whole[lo:hi - width + 1])
        else:
            yield grams(hashes[lo:hi], hi - lo)[:1] if hi > lo else np.zeros(0, np.uint64)


def frequent_buckets(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Which of 2**22 buckets of tokens are crowded, counted over all documents; a table of one fixed size.

    It only sets the order of tokens, which every set shares, so no result depends on it. A task's counts are bytes that
    stop at 255, far above what a task of any usual size has in a common bucket; sums are 64-bit numbers and stay on the
    executors. Bits of 512 KB come to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for part in blocks(batches, "text", _BLOCK):
            sets = list(shingle_sets(text_of(part, "text"), width))
            if sets:
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.int32(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(
            [p.tobytes() for p in np.split(np.minimum(total, 255).astype(np.uint8), _PARTS)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[part] = held.get(part, 0) + np.frombuffer(counts, np.uint8).astype(np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary()),
                                              pa.array([float(v.sum()) for v in held.values()])], names=["part", "counts", "total"])

    each = plain(docs, text).toDF("text").mapInArrow(count, "part int, counts binary")
    sums = stored(each.repartition(_PARTS, "part").mapInArrow(add, "part int, counts binary, total double"), "crowded")
    mean = (sums.agg(F.sum("total")).first()[0] or 0.0) / (1 << SKETCH_BITS)
    limit = mean + 8 * mean ** 0.5 + 30

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.frombuffer(c, np.int64) > limit).tobytes() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["part", "bits"])

    out = np.zeros((_PARTS, (1 << SKETCH_BITS) // _PARTS), bool)
    for r in sums.mapInArrow(above, "part int, bits binary").collect():
        out[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out.ravel()


def _signatures(docs: DataFrame, id: str, text: str, width: int, percent: int, crowded: np.ndarray) -> DataFrame:
    """id, digest of the set (null when empty), n, and the signature in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(crowded))
    fields = [T.StructField("digest", T.BinaryType()), T.StructField("key", T.LongType()),
              T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]

    def make():
        late = np.unpackbits(shared.value).astype(bool)

        def run(texts: pa.Array, part: pa.RecordBatch) -> list:
            sets = list(shingle_sets(texts, width))
            tokens = []
            for s in sets:
                hot = late[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                tokens.append(np.concatenate([s[~hot], s[hot]])[:signature_size(len(s), percent)])
            digests = _digests(sets)
            return [pa.array([d if len(s) else None for d, s in zip(digests, sets)], pa.binary()),
                    pa.array(_keys(digests, part.column(0)).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()), list_array(tokens)]
        return run

    return map_text(docs, ["id"], "text", fields, make, _BLOCK)


def _digests(sets: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def _keys(digests: list[bytes], ids: pa.Array) -> np.ndarray:
    """A word for set and id together, by which a filter finds the one document that stands for a set."""
    return mix(np.frombuffer(b"".join(digests), np.uint64)[::2] ^ id_hashes(ids))


def _ranks(tokens: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Places of tokens in the common order as 32-bit numbers; equal for tokens too near to tell apart."""
    hot = late[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return ((hot << np.uint64(31) | tokens >> np.uint64(33)).astype(np.int64) - (1 << 31)).astype(np.int32)


def _shared_tokens(sets: DataFrame, percent: int, crowded: np.ndarray) -> DataFrame:
    """(sid, n, bound, group, tokens): the signature tokens that other sets have too; sets with too few of them are out.

    `bound` is where the signature ends in the common order, how many of its tokens no other signature has, and the places
    of some of these.
    """
    order = sets.sparkSession.sparkContext.broadcast(np.packbits(crowded))
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 1")
    bits = sets.sparkSession.sparkContext.broadcast(bloom(counts, "token"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(order.value).astype(bool)
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten().to_numpy().view(np.uint64)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            there = in_bloom(bits.value, flat)
            whole = np.concatenate([[0], np.cumsum(lengths)])
            at = np.concatenate([[0], np.cumsum(there)])[whole]
            some = np.diff(at) > 0
            kept = flat[there].view(np.int64)
            own = pa.array(some)
            ranks = _ranks(flat[np.repeat(some, lengths)], late)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).filter(own), b.column(1).filter(own),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.diff(at)[some])]), pa.int32()),
                                          pa.array(kept)),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths[some])]), pa.int32()), pa.array(ranks))],
                names=["sid", "n", "tokens", "signature"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(order.value).astype(bool)
        for b in batches:
            last, missing, steps = [], [], []
            for tokens, signature in zip(b.column(3), b.column(4)):
                all = signature.values.to_numpy()
                gone = np.sort(all[~np.isin(all, _ranks(tokens.values.to_numpy().view(np.uint64), late))])
                last.append(all.max())
                missing.append(len(gone))
                # the i-th step is that of the ceil(i * missing / 16)-th missing token
                steps.append(gone[-(-np.arange(1, _STEPS + 1) * len(gone) // _STEPS) - 1] if len(gone) else np.full(_STEPS, (1 << 31) - 1, np.int32))
            steps = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * _STEPS, pa.int32()), pa.array(np.concatenate(steps), pa.int32()))
            made = pa.StructArray.from_arrays([pa.array(last, pa.int32()), pa.array(missing, pa.int64()), steps], ["last", "missing", "steps"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), made, b.column(2), b.column(3)], names=["sid", "n", "bound", "group", "tokens"])

    first = rows = stored(sets.select("sid", "n", "tokens").mapInArrow(keep, "sid bigint, n bigint, tokens array<bigint>, signature array<int>")
                          .where(F.size("tokens") >= _least_hits(percent)), "tokens")
    bits.destroy()
    # what is left is counted anew, exactly, until hardly a set goes: a token whose other sets are out is not shared
    before, now = None, rows.count()
    while before is None or now < 0.9 * before:
        each = rows.select("sid", "n", F.posexplode("tokens").alias("place", "token"))
        common = each.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
        rows = stored(each.join(common, "token").groupBy("sid", "n")
                      .agg(F.array_sort(F.collect_list(F.struct("place", "token", "sets"))).alias("t"))
                      .where(F.size("t") >= _least_hits(percent))
                      .select("sid", "n", F.col("t.token").alias("tokens"), F.col("t.sets").alias("sets")), "tokens")
        before, now = now, rows.count()
    # near copies share most of their tokens, so a token as frequent as most of a set's tokens names its group: a rarer
    # one would split the copies, a more frequent one throw them together with strangers
    middle = F.get(F.array_sort("sets"), F.floor(F.size("sets") / 2).cast("int"))
    usual = let(middle, lambda m: F.filter(F.arrays_zip("tokens", "sets"), lambda t: (t["sets"] * 2 >= m) & (t["sets"] <= m * 2)))
    named = rows.select("sid", "n", F.array_min(F.transform(usual, lambda t: t["tokens"])).alias("group"), "tokens")
    return stored(named.join(first.select("sid", "signature"), "sid").mapInArrow(
        bound, "sid bigint, n bigint, bound struct<last: int, missing: bigint, steps: array<int>>, group bigint, tokens array<bigint>"), "shared")


def _can(n: str, own: str, other: str) -> Column:
    """How many of n tokens a set can share with the other at most.

    A token that no other signature has is missing from the other set if it lies before the end of the other's signature;
    behind that end the other set may hold it.
    """
    before = sum((F.col(own)["steps"][i] < F.col(other)["last"]).cast("int") for i in range(_STEPS))
    return F.col(n) - F.ceil(before * F.col(own)["missing"] / F.lit(_STEPS))


def _fits(percent: int) -> Column:
    """Whether sets of n and m tokens can reach the threshold, by their sizes and by what each may hold of the other."""
    def reach(both: Column) -> Column:
        return both * 100 >= (F.col("n") + F.col("m") - both) * percent

    return reach(F.least("n", "m")) & reach(_can("n", "bound_n", "bound_m")) & reach(_can("m", "bound_m", "bound_n"))


def _least_hits(percent: int) -> Column:
    """Signature tokens that a set of n has in common with a linked one, which has need(n) tokens at least."""
    return 1 + F.floor(F.ceil(F.col("n") * percent / F.lit(100.0) - 1e-9) / _SPACING)


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """(sid, n, group, own, near): the groups that a set must be held against, its own among them.

    In its own group only tokens count that another member has too.
    """
    rows = sets.select("sid", "n", F.col("group").alias("home"), F.explode("tokens").alias("token"))
    matrix = rows.groupBy("token", F.col("home").alias("group")).agg(
        F.count("*").alias("members"), F.min("n").alias("least"), F.max("n").alias("most"))
    own = F.col("group") == F.col("home")
    met = (rows.join(matrix, "token").where((F.col("most") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("least") * percent))
           .where(~own | (F.col("members") > 1))
           .groupBy("sid", "n", "group", "home").agg(F.count("*").alias("hits"), F.sum("members").alias("near")))
    return met.where(F.col("hits") >= _least_hits(percent)).select("sid", "n", "group", own.alias("own"), "near")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = full.select(F.col("sid").alias("a"), F.col("hashes").alias("ha"))
    right = full.select(F.col("sid").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb"))
    return (pairs.join(left, "a").join(right, "b")
            .withColumn("both", both)
            .where(F.col("both") * 100 >= (F.size("ha") + F.size("hb") - F.col("both")) * percent)
            .select("a", "b"))


def linked(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id that links reach.

    Two documents link when 100 * |A n B| >= percent * |A u B| for their sets of word n-grams (A-Z lower-cased, words
    `[^\\x20\\x09-\\x0D]+`; with fewer words than `width` the whole sequence is the one n-gram). Documents without a word
    link with nothing and are their own component, also when repeated. Null ids take part; a component's id is its
    smallest id that is not null. Whole texts are read; no limit on the size of a group or on the partners of a document.
    """
    docs = plain(docs, id, text).toDF("id", "text")
    crowded = frequent_buckets(docs, "text", width)
    # stored, as the texts are not read again for the result
    signed = stored(_signatures(docs, "id", "text", width, percent, crowded), "signed")
    sets = stored(signed.where("digest is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("key").alias("key"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        .withColumn("sid", F.monotonically_increasing_id()), "sets")
    labels = _components(docs, sets, width, percent, crowded)
    named = sets.select("digest", "sid", "id").join(labels.withColumnRenamed("node", "sid"), "sid", "left") \
        .select("digest", "id", F.coalesce("comp", "sid").alias("comp"))
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_set = named.join(least, "comp").select(F.col("digest").alias("d"), "component_id")
    out = signed.select("id", "digest", F.col("n").alias("n_shingles"))
    return out.join(by_set, out.digest == by_set.d, "left").select(
        F.col("id").alias(id), "n_shingles", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _components(docs: DataFrame, sets: DataFrame, width: int, percent: int, crowded: np.ndarray) -> DataFrame:
    """(node, comp) for the sets that have candidates."""
    shared = _shared_tokens(sets, percent, crowded)
    found = stored(_candidates(shared, percent), "candidates")
    # members of the groups that someone is held against; how near each is to the rest of its group
    near = found.where("own").select("sid", "near")
    members = stored(shared.select("sid", "group", F.col("n").alias("m"), F.col("bound").alias("bound_m")).join(found.select("group").distinct(), "group", "left_semi")
                     .join(near, "sid", "left").fillna(0, ["near"]), "members")
    wanted = stored(found.select("sid").union(members.select("sid")).distinct(), "wanted")
    full = _whole_sets(docs, sets.join(wanted, "sid", "left_semi").select("sid", "digest", "key"), width)
    labels = wanted.select(F.col("sid").alias("node"), F.col("sid").alias("comp"))
    found = stored(found.select("sid", "n", "group").join(shared.select("sid", F.col("bound").alias("bound_n")), "sid"), "candidates")
    leaders, few = 1, _OPEN_PAIRS
    while True:
        # stored once a round, as the counts, the leaders and the pairs are all made of them: their plans stay small
        comp = labels.select(F.col("node").alias("sid"), "comp")
        asked = stored(found.join(comp, "sid"), "asked")
        there = stored(members.join(comp.withColumnRenamed("comp", "other"), "sid"), "there")
        # how many pairs of different components the open groups hold, without making them
        each = asked.groupBy("group", "comp").agg(F.count("*").alias("x")).join(
            there.groupBy("group", F.col("other").alias("comp")).agg(F.count("*").alias("y")), ["group", "comp"], "full") \
            .groupBy("group").agg(F.sum("x").alias("x"), F.sum("y").alias("y"),
                                  F.sum(F.coalesce(F.col("x") * F.col("y"), F.lit(0))).alias("same"))
        each = stored(each.where("x is not null and y is not null").withColumn("pairs", F.col("x") * F.col("y") - F.col("same"))
                      .where("pairs > 0").select("group", (F.col("pairs") > few * (F.col("x") + F.col("y"))).alias("large")), "pairs")
        open, left = each.agg(F.count("*"), F.count_if("large")).first()
        if not open:
            return labels
        whole, large = each.where("not large").select("group"), each.where("large").select("group")
        # both of a linked pair ask for each other's group, so in groups opened whole the lesser one's question will do
        held = there.select("group", F.col("sid").alias("b"), "m", "bound_m", "other", F.lit(False).alias("leads")).join(whole, "group", "left_semi")
        if left:
            first = stored(there.join(large, "group", "left_semi").groupBy("group", F.pmod(F.xxhash64("sid"), F.lit(leaders)).alias("s")).agg(
                F.max_by(F.struct("sid", "m", "bound_m", "other"), F.struct("near", F.col("sid"))).alias("l")).select("group", "l.*"), "leaders")
            held = held.unionByName(first.select("group", F.col("sid").alias("b"), "m", "bound_m", "other", F.lit(True).alias("leads")))
        pairs = asked.join(held, "group").where((F.col("comp") != F.col("other")) & (F.col("sid") != F.col("b")) & _fits(percent)
                                                & (F.col("leads") | (F.col("sid") < F.col("b")))) \
            .select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b")).distinct()
        labels = merged(labels, stored(_verified(pairs, full, percent), "links"))
        if not left:
            return labels
        # a leader has now been held against all who asked, and a group opened whole is done
        found = asked.join(large, "group", "left_semi").drop("comp")
        members = there.join(large, "group", "left_semi").join(first.select("group", "sid"), ["group", "sid"], "left_anti").drop("other")
        leaders, few = 2 * leaders, few * few // 2  # a round moves all whole sets, so there are few rounds


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, hashes) of the wanted sets, from a second reading of the documents.

    A filter of fixed size lets through the one document that names each set, so that few rows are moved.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "key"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", _BLOCK):
            sets = list(shingle_sets(text_of(part, "text"), width))
            digests = _digests(sets)
            kept = np.flatnonzero(in_bloom(bits.value, _keys(digests, part.column(0)))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in kept], pa.binary()),
                                              list_array([sets[i] for i in kept])], names=["digest", "hashes"])

    rows = docs.mapInArrow(read, "digest binary, hashes array<bigint>").join(wanted.select("sid", "digest"), "digest")
    # grouped as they were joined, so that the sets are shuffled once
    made = stored(rows.groupBy("digest").agg(F.first("sid").alias("sid"), F.first("hashes").alias("hashes")).drop("digest"), "whole")
    bits.destroy()
    return made
