"""Path algebra, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_root(path: Column) -> Column:
    return F.size(path) == 0


def parent(path: Column) -> Column:
    """The path one level up; null at the root."""
    return F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))))


def last(path: Column) -> Column:
    """The key under which a tree lies in its parent; null at the root."""
    return F.when(F.size(path) > 0, F.element_at(path, -1))


def child(path: Column, key: Column) -> Column:
    return F.concat(path, F.array(key))


def ancestors(path: Column) -> Column:
    """All paths above, the root's first."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(path) - 1, F.lit(0))), lambda k: F.slice(path, F.lit(1), k))).otherwise(F.array().cast("array<array<binary>>"))


def is_below(path: Column, other: Column) -> Column:
    """Whether path is other's or lies below it."""
    return (F.size(path) >= F.size(other)) & (F.slice(path, F.lit(1), F.size(other)) == other)


def reverse(path: Column) -> Column:
    return F.reverse(path)
