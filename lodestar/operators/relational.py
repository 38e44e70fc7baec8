"""Relational operators as thin compositions of DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.predicates import Filter, conjunction, sum_double

AGGREGATES = {"count": F.count, "sum": sum_double, "min": F.min, "max": F.max, "avg": F.avg, "count_distinct": F.count_distinct}


def scan(df: DataFrame, columns: Sequence[str | Column], filters: Sequence[Filter] = ()) -> DataFrame:
    """Listed columns of the rows that pass all filters; both reach the Parquet reader."""
    return df.where(conjunction(filters)).select(*columns)


def aggregate(df: DataFrame, keys: Sequence[str], functions: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(column, function, name) over groups, or over everything without keys: then one row, even of nothing."""
    columns = [AGGREGATES[fn](c).alias(name) for c, fn, name in functions]
    if not columns:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def inner_join(build: DataFrame, probe: DataFrame, build_keys: Sequence[str], probe_keys: Sequence[str], hint: str | None = None) -> DataFrame:
    on = [build[b] == probe[p] for b, p in zip(build_keys, probe_keys, strict=True)]
    return probe.join(build.hint(hint) if hint else build, on, "inner")


def semi_join(keep: DataFrame, other: DataFrame, keep_keys: Sequence[str], other_keys: Sequence[str]) -> DataFrame:
    """Each row of keep once if it has a partner: left semi with the build side kept, right semi with the probe side."""
    return keep.join(other, [keep[k] == other[o] for k, o in zip(keep_keys, other_keys, strict=True)], "left_semi")


#: Bits of a filter for each key of the build side, and its most; beyond that it lets more through, no less.
BITS_A_KEY, MOST_BITS = 16, 1 << 26


def key_filter(build: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """(word, bits) rows of a one-hash Bloom filter of the build side's keys, and its number of bits.

    n_keys is the checked number of rows; the filter has MOST_BITS / 64 rows of 16 bytes at most (16 MB), so it
    may be broadcast whatever the table.
    """
    n_bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS_A_KEY * max(1, n_keys) - 1).bit_length()))
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n_bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    kept = build.where(F.col(key).isNotNull())
    return kept.groupBy(F.floor(place / 64).alias("__word")).agg(F.bit_or(one).alias("__bits")), n_bits


def may_join(probe: DataFrame, key: str, words: DataFrame, n_bits: int) -> DataFrame:
    """The probe side's rows whose key's bit is set in the filter: all that have a partner, few that have none."""
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n_bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    met = probe.join(F.broadcast(words), F.floor(place / 64) == F.col("__word"))
    return met.where(F.col("__bits").bitwiseAND(one) != 0).select(probe.columns)


def bloom_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, checked_rows: int) -> DataFrame:
    """Inner join whose probe side is filtered by a Bloom filter of the build side's keys before it is shuffled."""
    words, n_bits = key_filter(build, build_key, checked_rows)
    return inner_join(build, may_join(probe, probe_key, words, n_bits), [build_key], [probe_key])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def frequencies(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """value, freq of the non-null values: rows, or the sum of a weight such as usage."""
    freq = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(freq.alias("freq"))


def max_and_top_frequency(df: DataFrame, column: str) -> DataFrame:
    """max_freq, and top_freq: the mean of the largest max(1000, 1 % of all) group sizes."""
    freq = frequencies(df, column)
    n = freq.count()
    return freq.orderBy(F.desc("freq")).limit(max(1000, n // 100)).agg(F.max("freq").alias("max_freq"), F.avg("freq").alias("top_freq"))
