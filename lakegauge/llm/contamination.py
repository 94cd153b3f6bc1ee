"""Benchmark passages in documents, by winnowing.

A window of ten words holds six 5-grams; the least of their hashes is its fingerprint. Equal windows have equal
fingerprints, so every shared span of ten words or more shares one. Training and test fingerprints are joined, and a hit
is extended to its whole window, whose words decide by a 128-bit digest. An item shorter than a window is one window
whose only gram is itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakegauge.llm.common import Words, blocks, bloom, grams, in_bloom, mix, spread, stored, text_of

WINDOW, GRAM = 10, 5

# what each byte becomes: A-Z lower case, digits, letters and all bytes of other scripts as they are, the rest a blank
_BYTES = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _plain(texts: pa.Array) -> pa.Array:
    """The texts with every byte that is no part of a word made a blank."""
    _, offsets, data = texts.buffers()
    data = _BYTES[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(data))


def _fingerprints(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least hash of the grams of each window, over a whole block."""
    least = grams(hashes, gram)
    reach, width = 1, window - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[step:], least[:len(least) - step])
        reach += step
    return least


def _starts(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of a size start that lie within one text, and the number of that text."""
    room = np.maximum(0, words.counts - size + 1)
    owner = np.repeat(np.arange(len(room)), room)
    return words.at[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(room) - room, room), owner


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def item_windows(items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item, size, print, digest): the distinct windows of every item. A null id is the item ''; a null text has none."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            words = Words(_plain(text_of(part, "text")))
            names = [w.encode() for w in words.vocabulary.to_pylist()]
            hashes = words.hashes()[words.codes]
            out = []
            whole = _fingerprints(hashes, window, gram)
            for s, i in zip(*(x.tolist() for x in _starts(words, window))):
                out.append((i, window, int(whole[s]), [names[c] for c in words.codes[s:s + window]]))
            for i in np.flatnonzero((words.counts > 0) & (words.counts < window)).tolist():
                own = slice(words.at[i], words.at[i + 1])
                size = int(words.counts[i])
                out.append((i, size, int(_short(hashes[own], size)[0]), [names[c] for c in words.codes[own]]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int32()),
                 pa.array(np.array([o[2] for o in out], np.uint64).view(np.int64)), pa.array([_digest(o[3]) for o in out], pa.binary())],
                names=["item", "size", "print", "digest"])

    rows = items.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(scan, "item string, size int, print bigint, digest binary").distinct(), "windows")


def _short(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words; runs of different sizes never share one but by chance."""
    return mix(grams(hashes, size) + np.uint64(size))


def _scanned(docs: DataFrame, tests: DataFrame, id: str, text: str, window: int, gram: int) -> DataFrame:
    """(uid, id, n_words, found): each document with the windows whose fingerprint may be that of an item.

    found lists print, digest, size and the places of a window. A Bloom filter of 8 MB holds the items' fingerprints,
    however many they are; what it lets pass is joined exactly.
    """
    spark = docs.sparkSession
    prints = spark.sparkContext.broadcast(bloom(tests.select("print").distinct(), "print"))
    sizes = [r["size"] for r in tests.select("size").distinct().collect()]  # at most `window` of them

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            words = Words(_plain(text_of(part, "text")))
            hashes = words.hashes()[words.codes]
            owners, keys, said, widths, places = [], [], [], [], []
            for size in sizes:
                starts, owner = _starts(words, size)
                if not len(starts):
                    continue
                marks = (_fingerprints(hashes, window, gram) if size == window else _short(hashes, size))[starts]
                hit = np.flatnonzero(in_bloom(prints.value, marks))
                if not len(hit):
                    continue
                # equal windows of a text are one, with all their places: they are told apart by the codes of their words
                codes = words.codes[starts[hit][:, None] + np.arange(size)]
                rows = np.column_stack([owner[hit], codes])
                order = np.lexsort(rows.T[::-1])
                new = np.ones(len(order), bool)
                new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
                heads = np.append(np.flatnonzero(new), len(order))
                at = starts[hit] - words.at[owner[hit]]
                first = order[heads[:-1]]
                names = words.vocabulary.take(pa.array(codes[first].ravel())).to_pylist()
                owners.append(owner[hit[first]])
                keys.append(marks[hit[first]].view(np.int64))
                widths.append(np.full(len(first), size, np.int32))
                said += [_digest([w.encode() for w in names[j:j + size]]) for j in range(0, len(names), size)]
                places += [at[order[a:b]] for a, b in zip(heads[:-1], heads[1:])]
            owner = np.concatenate([np.zeros(0, np.int64), *owners])
            order = np.argsort(owner, kind="stable")
            lists = [places[i] for i in order.tolist()]
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]), pa.int32()),
                                             pa.array(np.concatenate([np.zeros(0, np.int64), *lists]), pa.int64()))
            rows = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *keys])[order], pa.int64()), pa.array([said[i] for i in order.tolist()], pa.binary()),
                 pa.array(np.concatenate([np.zeros(0, np.int32), *widths])[order], pa.int32()), inner], names=["print", "digest", "size", "places"])
            ends = np.searchsorted(owner[order], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(words.counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)],
                names=["uid", "id", "n_words", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(scan, f"uid bigint, id {kind}, n_words bigint, "
                                        "found array<struct<print: bigint, digest: binary, size: int, places: array<bigint>>>"), "scanned")


def _kinds(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(print, digest, kind) and (kind, item): windows that the same items hold are of one kind.

    A kind is told by the number of its items and two sums of hashes over them, so that no list is gathered for a window
    which a third of the items hold; the items of a kind are those of its least window.
    """
    sets = tests.groupBy("print", "digest").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    windows = sets.select("print", "digest", F.struct("n", "x", "y").alias("kind"))
    one = windows.groupBy("kind").agg(F.min(F.struct("print", "digest")).alias("w")).select("kind", "w.print", "w.digest")
    return stored(windows, "kinds"), stored(tests.join(one, ["print", "digest"]).select("kind", "item"), "items")


def covered(hits: Column) -> Column:
    """How many words lie in the windows of an array of (start, size)."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(a, x):
        end = F.greatest(a["end"], x["start"] + x["size"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], F.least(x["start"], end))).alias("n"))

    return F.aggregate(F.array_sort(hits), zero, step, lambda a: a["n"])


def report(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters a to z (A to Z count as such) and all code points above ASCII. A word inside an
    occurrence of an item's window is hit; n_items counts the distinct ids of items with such a window. Null texts have no
    words; repeated rows, and rows with a null id, are documents of their own. Without items nothing is hit. Texts are
    read whole.

    A window that a third of the documents hold is no task of its own: windows that many hold are few by arithmetic (at
    most four a task), so that side of the join is broadcast for them, and only the rest is dealt by window.
    """
    tests = item_windows(items, item_id, item_text, window, gram)
    scanned = _scanned(docs, tests, id, text, window, gram)
    kinds, held = _kinds(tests)
    found = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.print", "f.digest", "f.size", "f.places")
    key = ["print", "digest"]
    # training meets test fingerprints: first the distinct windows, with how many documents hold each
    present = stored(found.groupBy(*key).agg(F.count("*").alias("n")).join(kinds, key), "present")
    total = present.agg(F.sum("n")).first()[0] or 0
    limit = max(1000, total // (4 * spread(docs.sparkSession)))
    many, few = present.where(F.col("n") > limit).select(*key, "kind"), present.where(F.col("n") <= limit).select(*key, "kind")
    seldom = found.join(F.broadcast(many.select(*key)), key, "left_anti")
    hits = stored(found.join(F.broadcast(many), key).unionByName(seldom.join(few, key)), "hits")
    at = F.transform("places", lambda p: F.struct(p.alias("start"), F.col("size").cast("bigint").alias("size")))
    words = hits.select("uid", at.alias("at")).groupBy("uid").agg(covered(F.flatten(F.collect_list("at"))).alias("n_hit"))
    named = hits.select("uid", "kind").distinct().join(held, "kind").groupBy("uid").agg(F.array_sort(F.collect_set("item")).alias("names"))
    sha = F.sha2(F.array_join(F.coalesce("names", F.array().cast("array<string>")), ",").cast("binary"), 256)
    out = scanned.select("uid", "id", "n_words").join(words, "uid", "left").join(named, "uid", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(F.col("id").alias(id), "n_words", hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_items"),
                      sha.alias("items_sha256"), (hit > 0).alias("contaminated"))


# the same in DuckDB, over documents and benchmark, window by window
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM bw),
sizes AS (SELECT DISTINCT size FROM bwin),
dw AS (SELECT rn, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
dwin AS (SELECT rn, size, s, array_to_string(w[s:s + size - 1], ' ') AS win FROM dw),
met AS (SELECT rn, s, dwin.size, item FROM dwin JOIN bwin ON dwin.size = bwin.size AND dwin.win = bwin.win),
hit AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(s, s + size)) AS p FROM met) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT rn, item FROM met) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""
