"""A digest of a file's pieces and their order, from splits that are read in parallel and in any order.

A file is a sequence of pieces, its bytes between line feeds. Its digest is a polynomial: the hash of piece i times the
i-th power of a base, summed modulo a prime. A split is summed as if the file began with its partition's rows; as sums
of splits are moved by a power of the base, they add up to the same digest however the file was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# 31-bit primes and a base for each: products of two residues fit a 64-bit word
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (48271, 69621, 40014, 16807)
_DIGIT, _DIGITS = 11, 3  # exponents of up to 33 bits, eleven at a time
_ROW = (1 << _DIGIT * _DIGITS) - 1  # the low bits of monotonically_increasing_id count the rows of a partition


def power(lane: int, exponent: Column) -> Column:
    """The base of a lane raised to an exponent below 2**33, from three tables of constants."""
    prime, out = PRIMES[lane], None
    for digit in range(_DIGITS):
        step = pow(BASES[lane], 1 << _DIGIT * digit, prime)
        table, value = [], 1
        for _ in range(1 << _DIGIT):
            table.append(str(value))
            value = value * step % prime
        powers = F.split(F.lit(",".join(table)), ",").cast("array<bigint>")  # folded into one constant
        at = F.shiftrightunsigned(exponent, _DIGIT * digit).bitwiseAND(F.lit((1 << _DIGIT) - 1)).cast("int")
        factor = F.get(powers, at)
        out = factor if out is None else out * factor % prime
    return out


def _residues(value: str) -> list[Column]:
    """Four numbers of 31 bits from two hashes of a piece, none of them 0, so that an empty piece counts too."""
    first, second = F.xxhash64(value), F.xxhash64(F.lit("second"), value)
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(0x7FFFFFFF)) % p + 1
            for (h, s), p in zip(((first, 33), (first, 2), (second, 33), (second, 2)), PRIMES)]


def file_digests(pieces: DataFrame, name: str, start: str, value: str) -> DataFrame:
    """(name, digest): of each file, from its pieces as its splits yield them.

    `pieces` is a scan of text files; `start` is the place of a split in its file, so rows with one name and start follow
    each other in one partition. One row per split is shuffled.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    rows = pieces.select(F.col(name).alias("name"), F.col(start).alias("start"), row.alias("row"),
                         *[r.alias(f"r{i}") for i, r in enumerate(_residues(value))])
    lanes = range(len(PRIMES))
    splits = rows.groupBy("name", "start").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("n"),
        *[(F.sum(F.col(f"r{i}") * power(i, F.col("row")) % PRIMES[i]) % PRIMES[i]).alias(f"s{i}") for i in lanes])
    before = F.sum("n").over(Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("shift", F.coalesce(before, F.lit(0)) - F.col("first"))
    # powers repeat after prime - 1, so a split is also moved back
    moved = [F.col(f"s{i}") * power(i, F.pmod(F.col("shift"), F.lit(PRIMES[i] - 1))) % PRIMES[i] for i in lanes]
    return splits.select("name", "n", *[m.alias(f"s{i}") for i, m in enumerate(moved)]).groupBy("name").agg(
        F.concat_ws(":", F.sum("n").cast("string"), *[(F.sum(f"s{i}") % PRIMES[i]).cast("string") for i in lanes]).alias("digest"))
