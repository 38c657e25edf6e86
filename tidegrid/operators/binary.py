"""Arithmetic between points and numbers, and between two sets of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.frames import BAND, EDGES, as_points
from tidegrid.functions import labels as L
from tidegrid.functions import uncertainty as U


def scalar(points: DataFrame, op: str, number: float, number_first: bool = False) -> DataFrame:
    """``points op number`` (or ``number op points``). A division by zero drops the point."""
    df, x = as_points(points), F.lit(float(number))
    own, exact = (F.col("lo"), F.col("hi")), (x, x)
    v = U.apply(op, x, F.col("v")) if number_first else U.apply(op, F.col("v"), x)
    ends = U.corners(op, *exact, *own) if number_first else U.corners(op, *own, *exact)
    out = U.with_band(df.withColumn("_v", v), ends, F.col("lo").isNotNull())
    return as_points(out.withColumn("v", F.col("_v")).where("v is not null"))


def numbers(op: str, a: float, b: float) -> float:
    """``a op b``; not a number for a division by zero."""
    if op == "/":
        return a / b if b else float("nan")
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _match_key(labels: Column, on: list[str] | None, ignoring: list[str] | None) -> Column:
    return L.canonical(L.keep(labels, on) if on is not None else L.drop(labels, ignoring or []))


def series(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    """``left op right``: every left series with the right series of equal key, at equal times.

    The key is all labels, those of ``on``, or all but those of ``ignoring``. One left series (the first) takes
    a key; of several right series with a key the last does. With neither list, a single right series that
    found no partner is paired with all left series that found none. Left labels are kept.

    Partners are chosen from the smallest left and largest right series of each key, aggregated before the
    shuffle; only rows of chosen series meet, by key and time.
    """
    if on is not None and ignoring is not None:
        raise ValueError("either on or ignoring")
    key = _match_key(F.col("labels"), on, ignoring)
    ours, theirs = (as_points(df).withColumn("key", key) for df in (left, right))
    firsts = ours.groupBy("key").agg(F.min("series").alias("_l"))
    lasts = theirs.groupBy("key").agg(F.max("series").alias("_r"))
    partners = firsts.join(lasts, "key")
    values = ["v", *BAND, *EDGES]
    other = [F.col(c).alias(f"r_{c}") for c in values]
    a = ours.join(partners.select("key", F.col("_l").alias("series")), ["key", "series"], "left_semi")
    b = theirs.join(partners.select("key", F.col("_r").alias("series")), ["key", "series"], "left_semi")
    both = a.join(b.select("key", "t", *other), ["key", "t"]).select("t", "series", "labels", *values, *[f"r_{c}" for c in values])
    if on is None and ignoring is None:
        over = lasts.join(firsts, "key", "left_anti")
        only = over.agg(F.min("key").alias("key"), F.max("key").alias("_k"), F.max("_r").alias("series")).where("key = _k").select("key", "series")
        single = theirs.join(F.broadcast(only), ["key", "series"], "left_semi").select("t", *other)  # one row at most is broadcast
        alone = ours.join(partners.select("key", F.col("_l").alias("series")), ["key", "series"], "left_anti").select("t", "series", "labels", *values)
        both = both.unionByName(alone.join(single, "t"))
    out = both.withColumn("_v", U.apply(op, F.col("v"), F.col("r_v"))).where("_v is not null")
    return as_points(U.combine_reads(out, op).withColumn("v", F.col("_v")))
