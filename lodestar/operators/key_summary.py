"""Key summaries: a small bitmap on each row that records which buckets of another table's column its key reaches.

A filter on that column then prunes this table before the join: rows whose summary shares no bit with the
filter's mask have no partner.  Summaries live in a column of their own; sound for inner and semi joins only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.predicates import Filter, summary_check
from lodestar.operators.statistics import Histogram

MAX_BITS = 62


@dataclass(frozen=True)
class Conjunction:
    """Several filters that one value of a column must pass."""

    filters: tuple[Filter, ...]


@dataclass(frozen=True)
class Summary:
    """Bits [offset, offset + bits) of `column` on the target, from source.column by its histogram."""

    source: str
    source_column: str
    target: str
    histogram: Histogram
    bits: int
    offset: int = 0
    column: str = "ks"
    version: str = ""

    def __post_init__(self):
        if not 0 < self.bits or self.offset < 0 or self.offset + self.bits > MAX_BITS:
            raise ValueError("summaries have 62 bits in all")

    def mask(self, filter_: Filter | Conjunction) -> int | None:
        """The bits a row that joins with a row passing the filter may have; None if the filter is of no use.

        One value passes all of a conjunction's filters, so its bit is in each of their masks.
        """
        if isinstance(filter_, Conjunction):
            masks = [m for m in map(self.mask, filter_.filters) if m is not None]
            return reduce(lambda a, b: a & b, masks) if masks else None
        if filter_.col != self.source_column or not self.histogram.lows:
            return None
        place = lambda v: self.histogram.bit(self.histogram.bucket(v), self.bits, self.offset)
        last = place(self.histogram.lows[-1])
        span = lambda lo, hi: sum(1 << b for b in range(lo, hi + 1))
        v = filter_.values
        if filter_.expr == "eq":
            return span(place(v[0]), place(v[0]))
        if filter_.expr in ("lt", "le"):
            return span(self.offset, place(v[0]))
        if filter_.expr in ("gt", "ge"):
            return span(place(v[0]), last)
        if filter_.expr == "between":
            return span(place(v[0]), place(v[1])) if v[0] <= v[1] else 0
        if filter_.expr == "in":
            mask = 0
            for x in v:
                mask |= 1 << place(x)
            return mask
        return None


def build(source: DataFrame, source_key: str, summary: Summary) -> DataFrame:
    """key, bits: for each key of the source the OR of its values' bits; pre-aggregated before the shuffle."""
    value = F.col(summary.source_column)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), summary.histogram.bit_column(summary.source_column, summary.bits, summary.offset))
    kept = source.where(value.isNotNull() & F.col(source_key).isNotNull())
    return kept.groupBy(F.col(source_key).alias("key")).agg(F.bit_or(bit).alias("bits"))


def build_compound(source: DataFrame, source_key: str, conditions: Sequence[Column]) -> DataFrame:
    """key, bits: bit k is set if the key joins with a row that satisfies condition k as a whole."""
    bits = [F.bit_or(F.when(c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")) for k, c in enumerate(conditions)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return source.where(F.col(source_key).isNotNull()).groupBy(F.col(source_key).alias("key")).agg(out.alias("bits"))


def build_path(hops: Sequence[tuple[DataFrame, str, str]], source: DataFrame, source_key: str, summary: Summary) -> DataFrame:
    """Along a chain of joins: each hop (table, key, next key) carries the bits on from its key to its next key."""
    bits = build(source, source_key, summary)
    for table, key, following in hops:
        linked = table.select(F.col(key).alias("key"), F.col(following).alias("to")).join(bits, "key")
        bits = linked.groupBy(F.col("to").alias("key")).agg(F.bit_or("bits").alias("bits"))
    return bits


def attach(target: DataFrame, target_key: str, bits: DataFrame, column: str = "ks") -> DataFrame:
    """The target with its summary; a row without partner has 0.  Present bits of the column are kept."""
    joined = target.join(bits.withColumnsRenamed({"key": "__key", "bits": "__bits"}), F.col(target_key) == F.col("__key"), "left")
    new = F.coalesce("__bits", F.lit(0).cast("long"))
    value = F.col(column).bitwiseOR(new) if column in target.columns else new
    return joined.withColumn(column, value).drop("__key", "__bits")


def reset(target: DataFrame, column: str = "ks") -> DataFrame:
    return target.withColumn(column, F.lit(0).cast("long"))


def refresh(target: DataFrame, target_key: str, touched: DataFrame, source: DataFrame, source_key: str, summary: Summary) -> DataFrame:
    """Recomputes the summaries of the touched keys (column `key`) after an update of the source; other rows keep theirs."""
    touched = touched.select("key").distinct()
    new = build(source.join(touched.withColumnRenamed("key", source_key), source_key, "left_semi"), source_key, summary)
    new = touched.join(new, "key", "left").select("key", F.coalesce("bits", F.lit(0).cast("long")).alias("__new"))
    joined = target.join(new.withColumnRenamed("key", "__key"), F.col(target_key) == F.col("__key"), "left")
    wide = ((1 << summary.bits) - 1) << summary.offset
    others = F.col(summary.column).bitwiseAND(F.lit(~wide).cast("long"))
    value = F.when(F.col("__key").isNull(), F.col(summary.column)).otherwise(others.bitwiseOR(F.col("__new")))
    return joined.withColumn(summary.column, value).drop("__key", "__new")


def reduced(target: DataFrame, checks: Sequence[tuple[Summary, Filter | Conjunction]], versions: Mapping[str, str] | None = None) -> DataFrame:
    """The target's rows that may join, one check for each summary and filter.

    versions: of each source as it is now.  A summary that was made from another one is refused, as it could
    lack rows; one made without a version only stands for a source without one.
    """
    for summary, filter_ in checks:
        now = (versions or {}).get(summary.source, "")
        if summary.version != now:
            raise ValueError(f"the summary of {summary.source} is of version {summary.version!r}, not {now!r}")
        mask = summary.mask(filter_)
        if mask is not None:
            target = target.where(summary_check(summary.column, mask))
    return target
