"""What several operators share: text blocks in Arrow, word tables, Bloom filters of fixed size, stored tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakegauge.session import discard, work_path

BLOCK_BYTES = 4 << 20
_paths: ContextVar[list[str] | None] = ContextVar("paths", default=None)  # of what is stored inside `settled`
WHITE = "\x09\x0a\x0b\x0c\x0d\x20"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: lineage ends here, lost executors cost nothing."""
    path = work_path(df.sparkSession, name)
    if (held := _paths.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Stores the rows that `make` plans, then deletes whatever was stored while it planned them: only these rows read it.

    So a step's working files do not stand beside those of the next ones.
    """
    inner: list[str] = []
    outer = _paths.set(inner)
    try:
        made = make()
    except BaseException:
        discard(spark, inner)
        raise
    finally:
        _paths.reset(outer)
    try:
        return stored(made, name)
    finally:
        discard(spark, inner)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand `rows` rows at most to Python at a time: a batch of texts stands in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns cannot clash with working ones."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def remainder(c: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; 0 for a null id."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts, F.lit(0))


# --- texts in Arrow ----------------------------------------------------------------------------------

def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` bytes of text, or a single longer one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
            give_back()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Returns memory that a block has freed to the system: workers are kept between tasks, and what one operator left in
    its heap would stand beside the arrays of the next."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column as a string array without nulls and without an offset."""
    c = batch.column(batch.schema.get_field_index(name))
    return pa.concat_arrays([pc.fill_null(c.cast(pa.string()), "")])


def map_text(df: DataFrame, keep: Sequence[str], text: str, fields: Sequence[T.StructField],
             make: Callable[[], Callable[[pa.Array, pa.RecordBatch], list]], limit: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns and new ones, which the function made once per task computes from texts and kept columns.

    A kept column that has the name of a new one gives way to it.
    """
    new = [f.name for f in fields]
    keep = [c for c in keep if c not in new]
    source = df.select(*[F.col(f"`{c}`").alias(c) for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for part in blocks(batches, "__text", limit):
            made = fn(text_of(part, "__text"), part)
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(len(keep))]
                + [v if isinstance(v, pa.Array) else pa.array(v) for v in made], names=keep + new)

    return source.mapInArrow(run, schema)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: codes into `vocabulary`, text i holding codes[at[i]:at[i + 1]]."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        at = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        at = at - at[0]
        there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        if not there.all():
            flat = flat.filter(pa.array(there))
            at = np.concatenate([[0], np.cumsum(there)])[at]
        coded = flat.dictionary_encode()
        self.at = at
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per entry of the vocabulary."""
        return text_hashes(self.vocabulary)


def text_hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def id_hashes(ids: pa.Array) -> np.ndarray:
    """A 64-bit word per id, whatever its type; null counts as 0 or as an empty text."""
    if pa.types.is_integer(ids.type):
        return mix(pc.fill_null(ids, 0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64))
    return text_hashes(pc.fill_null(ids.cast(pa.string()), ""))


def list_array(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """Arrays of numbers as one list column."""
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64) if kind == pa.int64() else flat, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive items; len(hashes) - n + 1 of them."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i:i + size]
        out ^= out >> np.uint64(29)
    return mix(out)


def segments(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew in every segment of the given lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i, 0 for an empty range."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


# --- Bloom filters ----------------------------------------------------------------------------------------

BLOOM_BITS = 26
_PROBES = 3


def bloom(df: DataFrame, key: str) -> np.ndarray:
    """A filter over a column of 64-bit hashes, as 2**26 bits whatever the number of rows (8 MB, safe to broadcast).

    It only spares work: what passes is always joined exactly afterwards, and a full filter lets all pass.
    """
    bit = (1 << BLOOM_BITS) - 1
    probes = F.explode(F.array(*[F.shiftrightunsigned(F.col(key), 20 * i).bitwiseAND(bit) for i in range(_PROBES)]))
    words = (df.select(probes.alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def in_bloom(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for i in range(_PROBES):
        p = (hashes >> np.uint64(20 * i)) & np.uint64((1 << BLOOM_BITS) - 1)
        out &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return out


def spread(spark: SparkSession) -> int:
    """How many parts to deal rows to by hand: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
