"""Ordered arrays as columns: sort, find by halving, insert, remove, drop neighbours that are alike; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find(ordered: Column, value: Column) -> Column:
    """The place, from 0, of the first element of a sorted array that isn't below value; the array's size if there is none."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + 2)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))

    def halve(s, _):
        mid = F.floor((s.low + s.high) / 2).cast("int")
        below = (s.low < s.high) & (F.get(ordered, mid) < value)
        return F.struct(F.when(below, mid + 1).otherwise(s.low).alias("low"), F.when(below | (s.low >= s.high), s.high).otherwise(mid).alias("high"))

    return F.aggregate(rounds, start, halve, lambda s: s.low)


def holds(ordered: Column, value: Column) -> Column:
    return F.coalesce(F.get(ordered, find(ordered, value)) == value, F.lit(False))


def insert(ordered: Column, value: Column) -> Column:
    """The sorted array with value in its place; unchanged if it is there."""
    at = find(ordered, value)
    grown = F.concat(F.slice(ordered, F.lit(1), at), F.array(value), F.slice(ordered, at + 1, F.size(ordered)))
    return F.when(holds(ordered, value), ordered).otherwise(grown)


def remove(ordered: Column, value: Column) -> Column:
    """The sorted array without one element that equals value."""
    at = find(ordered, value)
    return F.when(holds(ordered, value), F.concat(F.slice(ordered, F.lit(1), at), F.slice(ordered, at + 2, F.size(ordered)))).otherwise(ordered)


def compress(values: Column) -> Column:
    """Without elements that equal the one before."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))


def extend(values: Column, size: Column, fill: Column) -> Column:
    """Filled up to a size."""
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), size - F.size(values)).cast("int")))
