"""Arithmetic on values with uncertainty bands.

Bands and the edges of the reads they come from are plain columns. Intermediate values are columns of their
own, so that no expression is repeated in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("+", "-", "*", "/")


def apply(op: str, a: Column, b: Column) -> Column:
    """``a op b``; null for a division by zero."""
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return F.try_divide(a, b)
    raise ValueError(f"unknown operator {op!r}")


def corners(op: str, a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """array<double> of ``op`` at the four corners of two bands; null where the result has no bounds."""
    values = F.array(*[apply(op, x, y) for x in (a_lo, a_hi) for y in (b_lo, b_hi)])
    return F.when(~((b_lo <= 0) & (b_hi >= 0)), values) if op == "/" else values


def with_band(df: DataFrame, values: Column, has: Column) -> DataFrame:
    """``df`` with lo and hi, the span of ``values`` where ``has``; null if any of them isn't finite."""
    ok = F.forall("_span", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.withColumn("_span", F.when(has, values))
    return df.withColumns({"lo": F.when(ok, F.array_min("_span")), "hi": F.when(ok, F.array_max("_span"))}).drop("_span")


def widened(df: DataFrame, lo: str, hi: str, v: str, lb: str, le: str, rb: str, re: str) -> DataFrame:
    """``df`` with the rate band (lo, hi) as if read within the span u_lb, u_le, u_rb, u_re; never narrower.

    A rate's low bound is over the longest time that the read allows and its high bound over the shortest, so
    both change by the ratio of these times. Only rows with ``_apart`` change.
    """
    longest, shortest = F.col(re) - F.col(lb), F.col(rb) - F.col(le)
    all_longest, all_shortest = F.col("u_re") - F.col("u_lb"), F.col("u_rb") - F.col("u_le")
    sound = F.col("_apart") & (longest > 0) & (shortest > 0) & (all_longest > 0) & (all_shortest > 0)
    return df.withColumns(
        {
            lo: F.when(sound & F.col(lo).isNotNull(), F.least(lo, F.col(lo) * F.try_divide(longest, all_longest), v)).otherwise(F.col(lo)),
            hi: F.when(sound & F.col(hi).isNotNull(), F.greatest(hi, F.col(hi) * F.try_divide(shortest, all_shortest), v)).otherwise(F.col(hi)),
        }
    )


def combine_reads(df: DataFrame, op: str) -> DataFrame:
    """Bands and edges of ``v op r_v`` as lo, hi and e_*; the other side's columns start with r_.

    A value without a band is exact if the other has one. Values from different reads are first widened to
    the span of both reads; the result has edges only if both came from the same read.
    """
    names = ("lb", "le", "rb", "re")
    equal = F.lit(True)
    for n in names:
        equal = equal & F.col(f"e_{n}").eqNullSafe(F.col(f"r_e_{n}"))
    df = df.withColumn("_equal", equal)
    span = {f"u_{n}": (F.least if n in ("lb", "rb") else F.greatest)(f"e_{n}", f"r_e_{n}") for n in names}
    apart = F.col("e_lb").isNotNull() & F.col("r_e_lb").isNotNull() & ~F.col("_equal")
    df = df.withColumns(span | {"_apart": apart, "_banded": F.col("lo").isNotNull() | F.col("r_lo").isNotNull()})
    for p in ("", "r_"):
        df = widened(df, f"{p}lo", f"{p}hi", f"{p}v", *[f"{p}e_{n}" for n in names])
    side = lambda p: (F.coalesce(f"{p}lo", f"{p}v"), F.coalesce(f"{p}hi", f"{p}v"))
    df = with_band(df, corners(op, *side(""), *side("r_")), F.col("_banded"))
    return df.withColumns({f"e_{n}": F.when(F.col("_equal"), F.col(f"e_{n}")) for n in names})


def all_or_none(points: DataFrame) -> DataFrame:
    """``points`` with bands only in series of which every point has one, as they are given out."""
    whole = points.groupBy("series").agg(F.min(F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("_whole"))
    met = points.join(whole, "series")
    return met.withColumns({c: F.when(F.col("_whole"), F.col(c)) for c in ("lo", "hi")}).select(*points.columns)
