"""Predicates and expressions: filter specifications as Columns, parameters, date helpers."""

from __future__ import annotations

import operator
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Any, Any], Any]] = {"lt": operator.lt, "le": operator.le, "eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class Parameter:
    """A value bound by name when the plan is made."""

    name: str


@dataclass(frozen=True)
class Filter:
    """col <expr> values: one of COMPARE, `between` (two values, ends open or closed), `in` or `not_null`."""

    col: str
    expr: str
    values: tuple = ()
    left_closed: bool = True
    right_closed: bool = True

    def bound(self, parameters: Mapping[str, Any]) -> Filter:
        values = tuple(parameters[v.name] if isinstance(v, Parameter) else v for v in self.values)
        return Filter(self.col, self.expr, values, self.left_closed, self.right_closed)

    def column(self, prefix: str = "") -> Column:
        x = F.col(prefix + self.col)
        if self.expr in COMPARE:
            return COMPARE[self.expr](x, F.lit(self.values[0]))
        if self.expr == "between":
            low, high = self.values
            return (x >= low if self.left_closed else x > low) & (x <= high if self.right_closed else x < high)
        if self.expr == "in":
            return x.isin(list(self.values))
        if self.expr == "not_null":
            return x.isNotNull()
        raise ValueError(f"no such predicate: {self.expr}")


def conjunction(filters: Sequence[Filter], prefix: str = "") -> Column:
    return reduce(operator.and_, (f.column(prefix) for f in filters), F.lit(True))


def sampled_literal(values: Sequence[Any], number: int) -> Any:
    """The literal a `?` of the number-th call stands for, drawn from a value sample the same way every time."""
    return random.Random(number).choice(list(values))


def sum_double(column: Column | str) -> Column:
    """SUM whose result is a double whatever it adds up."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast("double"))


def summary_check(column: str, mask: int) -> Column:
    """True if a key summary shares a bit with the mask."""
    return F.col(column).bitwiseAND(F.lit(mask).cast("long")) != 0


def parse_date(column: Column | str) -> Column:
    return F.to_date(column, "yyyy-MM-dd")


def encode(column: str, values: Sequence[str]) -> Column:
    """Order-preserving code of a string: its place among the sorted values; null if it is none of them."""
    places = F.create_map(*[F.lit(x) for pair in ((v, i) for i, v in enumerate(sorted(values))) for x in pair])
    return F.try_element_at(places, F.col(column))


def decode(column: str, values: Sequence[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in sorted(values)]), F.col(column) + 1)
