"""Column profiles and histograms."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from math import isqrt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.relational import frequencies, max_and_top_frequency

#: Distinct values up to which a frequency table is brought to the driver; beyond, values are binned first.
DRIVER_VALUES = 1_000_000
#: Such bins are this many to a bucket, cut by a sample of this many rows to a bin.
BINS, SAMPLED = 64, 16

#: Values that JSON has no form for: name, type, from and to text.
_TEXT_FORMS = [("datetime", datetime, datetime.isoformat, datetime.fromisoformat), ("date", date, date.isoformat, date.fromisoformat), ("decimal", Decimal, str, Decimal)]


def _to_text(value: Any) -> dict[str, str]:
    return next({name: to(value)} for name, kind, to, _ in _TEXT_FORMS if isinstance(value, kind))


def _from_text(value: dict[str, Any]) -> Any:
    return next((back(value[name]) for name, _, _, back in _TEXT_FORMS if list(value) == [name]), value)


@dataclass(frozen=True)
class Histogram:
    """Buckets [lows[k], highs[k]], both ends inclusive, with their row counts."""

    lows: tuple
    highs: tuple
    counts: tuple

    def bucket(self, value: Any) -> int:
        """The bucket of a literal: gaps belong to the bucket before, values beyond an end to the end bucket."""
        return max(0, bisect_right(self.lows, value) - 1)

    def bucket_column(self, column: str | Column) -> Column:
        """bucket() as an expression: comparisons only, so it stays in generated code."""
        x = F.col(column) if isinstance(column, str) else column
        return reduce(lambda a, b: a + b, ((x >= F.lit(low)).cast("int") for low in self.lows[1:]), F.lit(0))

    def bit(self, bucket: int, bits: int, offset: int) -> int:
        return bucket // -(-len(self.lows) // bits) + offset

    def bit_column(self, column: str, bits: int, offset: int) -> Column:
        """bit() of a value's bucket: only the buckets that begin a bit are compared with."""
        wide = max(1, -(-len(self.lows) // bits))
        return reduce(lambda a, b: a + b, ((F.col(column) >= F.lit(low)).cast("int") for low in self.lows[wide::wide]), F.lit(0)) + offset

    def covered(self, low: Any, high: Any) -> float:
        """The share of rows in buckets that [low, high] reaches, whole buckets at a time."""
        total = sum(self.counts)
        return sum(c for a, b, c in zip(self.lows, self.highs, self.counts, strict=True) if b >= low and a <= high) / total if total else 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=_to_text)

    @classmethod
    def from_json(cls, text: str) -> Histogram:
        return cls(**{k: tuple(v) for k, v in json.loads(text, object_hook=_from_text).items()})


def _table(df: DataFrame, column: str, parts: int, weight: str | None) -> list[tuple[Any, Any, int]]:
    """(low, high, freq) in order of value: one entry a value, or bins much finer than a bucket if there are too many."""
    freq = frequencies(df, column, weight)
    if freq.limit(DRIVER_VALUES + 1).count() <= DRIVER_VALUES:
        return [(r["value"], r["value"], r["freq"]) for r in freq.orderBy("value").collect()]
    bins = _bin(freq, "value", _fine_cuts(df, column, BINS * parts))
    rows = freq.groupBy(bins.alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("freq").alias("freq"))
    return [(r["low"], r["high"], r["freq"]) for r in rows.orderBy("bin").collect()]


def _fine_cuts(df: DataFrame, column: str, n: int) -> list:
    """About n values that cut the rows evenly, whatever their type, from a sample of about SAMPLED * n rows."""
    present = df.select(column).where(F.col(column).isNotNull())
    rate = SAMPLED * n / max(1, present.count())
    values = sorted(r[0] for r in (present.sample(False, rate, 7) if rate < 1 else present).collect())
    return sorted(set(values[:: max(1, len(values) // n)]))


def _bin(df: DataFrame, column: str, cuts: Sequence) -> Column:
    """How many cuts are not above a value: looked for among every wide-th cut, then among those from there to the next."""
    kind = df.schema[column].dataType
    lit = lambda v: F.lit(v).cast(kind)
    wide = max(1, isqrt(len(cuts)))
    x = F.col(column)
    outer = reduce(lambda a, b: a + b, ((x >= lit(low)).cast("int") for low in cuts[wide::wide]), F.lit(0))
    groups = F.array(*[F.array(*map(lit, cuts[k : k + wide])) for k in range(0, len(cuts), wide)])
    return outer * wide + F.size(F.filter(F.element_at(groups, outer + 1), lambda low: low <= x))


def _from_cuts(table: Sequence[tuple[Any, Any, int]], ends: Sequence[int]) -> Histogram:
    """A histogram whose buckets end after the entries numbered ends."""
    lows, highs, counts, start = [], [], [], 0
    for end in ends:
        part = table[start : end + 1]
        lows.append(part[0][0])
        highs.append(part[-1][1])
        counts.append(sum(f for _, _, f in part))
        start = end + 1
    return Histogram(tuple(lows), tuple(highs), tuple(counts))


def equi_depth(df: DataFrame, column: str, parts: int = 64, weight: str | None = None) -> Histogram:
    """Buckets of about equal row counts; one value each if there are no more values than buckets."""
    table = _table(df, column, parts, weight)
    least = 1 if len(table) <= parts else sum(f for _, _, f in table) / parts
    ends, fill = [], 0
    for k, (_, _, f) in enumerate(table):
        fill += f
        if fill >= least and len(ends) < parts - 1:
            ends.append(k)
            fill = 0
    if table and (not ends or ends[-1] != len(table) - 1):
        ends.append(len(table) - 1)
    return _from_cuts(table, ends)


def equi_width(df: DataFrame, column: str, parts: int = 64, weight: str | None = None) -> Histogram:
    """A bucket ends when the next value is more than (max - min) / parts beyond its first."""
    table = _table(df, column, parts, weight)
    if not table:
        return Histogram((), (), ())
    width = (table[-1][1] - table[0][0]) / parts
    ends, low = [], table[0][0]
    for k in range(len(table) - 1):
        if table[k + 1][0] - low > width:
            ends.append(k)
            low = table[k + 1][0]
    return _from_cuts(table, [*ends, len(table) - 1])


def max_diff(df: DataFrame, column: str, parts: int = 64, weight: str | None = None) -> Histogram:
    """Buckets end at the parts - 1 largest gaps between neighbouring values (the first ones of equal gaps)."""
    table = _table(df, column, parts, weight)
    if not table:
        return Histogram((), (), ())
    gaps = sorted(range(len(table) - 1), key=lambda k: (-(table[k + 1][0] - table[k][1]), k))
    return _from_cuts(table, [*sorted(gaps[: parts - 1]), len(table) - 1])


def compressed(df: DataFrame, column: str, parts: int = 64, weight: str | None = None) -> Histogram:
    """Like equi_depth, but values that fill a bucket alone get one of their own."""
    table = _table(df, column, parts, weight)
    least = 1 if len(table) <= parts else sum(f for _, _, f in table) / parts
    ends, fill = [], 0
    for k, (_, _, f) in enumerate(table):
        alone = f >= least
        if alone and fill:
            ends.append(k - 1)
            fill = 0
        fill += f
        if fill >= least:
            ends.append(k)
            fill = 0
    if table and (not ends or ends[-1] != len(table) - 1):
        ends.append(len(table) - 1)
    return _from_cuts(table, ends)


def profile(df: DataFrame, columns: Sequence[str], unique: Sequence[str] = ()) -> DataFrame:
    """col, n, ndv, min_value, max_value (as doubles), max_freq, top_freq: one pass for all columns, one more for frequencies.

    Columns declared unique need no frequencies.
    """
    spark = df.sparkSession
    fields = []
    for c in columns:
        fields += [F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}")]
        fields += [] if c in unique else [F.count_distinct(c).alias(f"d_{c}")]
    row = df.agg(*fields).first()
    out = []
    for c in columns:
        n = row[f"n_{c}"]
        if c in unique:
            out.append((c, n, n, row[f"lo_{c}"], row[f"hi_{c}"], 1, 1.0))
        else:
            top = max_and_top_frequency(df, c).first()
            out.append((c, n, row[f"d_{c}"], row[f"lo_{c}"], row[f"hi_{c}"], top["max_freq"], top["top_freq"]))
    return spark.createDataFrame(out, "col string, n long, ndv long, min_value double, max_value double, max_freq long, top_freq double")


def value_sample(df: DataFrame, column: str, size: int = 1000, seed: int = 7) -> list:
    """About `size` of the distinct values."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    n = values.count()
    return sorted(r[0] for r in (values if n <= size else values.sample(False, size / n, seed)).collect())
