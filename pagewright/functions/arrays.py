"""Columns over arrays: values bound once, and running states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a stretch: a running state copies its arrays within stretches only, so it takes time in proportion to n.
STRETCH = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for each row, however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, neutral: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the state before it: `start`, then merge(state, element).

    merge(state, merge(...merge(neutral, x)..., y)) has to be merge(...merge(state, x)..., y): a stretch of elements
    counts as one. Null gives null.
    """

    def fold(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def states(cut: Column) -> Column:
        wholes = F.transform(cut, lambda xs: F.aggregate(xs, neutral, merge))
        inside = lambda starts: F.flatten(F.transform(cut, lambda xs, i: F.slice(fold(xs, F.get(starts, i)), 1, F.size(xs))))
        return let(fold(wholes, start), inside)

    def stretches(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int")), lambda i: F.slice(xs, i * STRETCH + 1, STRETCH))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.slice(F.array(start), 1, 0)).otherwise(let(stretches(xs), states)))
