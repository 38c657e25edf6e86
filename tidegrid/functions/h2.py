"""Geometry of log-linear histograms, as Column expressions over whole numbers.

With grouping power p, values below 2 ** (p + 1) have buckets of their own; above, each power of two is cut
into 2 ** p equal buckets. Bucket bounds are inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_index(value: Column, p: int) -> Column:
    cutoff = 1 << (p + 1)
    v = value.cast("long")
    e = F.length(F.bin(v)) - 1  # floor of log2, exact
    rest = _shift_right(v - _power(e), e - p)
    return F.when(v < cutoff, v).otherwise(cutoff + (e - (p + 1)) * (1 << p) + rest).cast("int")


def _power(e: Column) -> Column:
    """2 ** e, as a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), e.cast("int"))


def _shift_right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, F.greatest(n, F.lit(0)).cast("int"))


def _parts(index: Column, p: int) -> tuple[Column, Column]:
    """(exponent, place within it) of an index beyond the linear ones."""
    k = index.cast("long") - (1 << (p + 1))
    return F.call_function("shiftright", k, F.lit(p)) + (p + 1), F.pmod(k, F.lit(1 << p))


def bucket_start(index: Column, p: int) -> Column:
    e, at = _parts(index, p)
    return F.when(index < (1 << (p + 1)), index.cast("long")).otherwise(_power(e) + at * _power(e - p))


def bucket_end(index: Column, p: int) -> Column:
    e, _ = _parts(index, p)
    return F.when(index < (1 << (p + 1)), index.cast("long")).otherwise(bucket_start(index, p) + _power(e - p) - 1)


def bucket_mid(index: Column, p: int) -> Column:
    return (bucket_start(index, p).cast("double") + bucket_end(index, p).cast("double")) / 2


def total_buckets(p: int, n: int) -> int:
    """How many buckets values of n bits need."""
    return (n - p + 1) << p
