"""Counters: rates on a grid or between samples, and their second derivative.

A counter that falls was reset; its value is then its increase. Rates are of the step, not of a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.frames import SECOND, as_points, as_samples, floor_step

_ORDER = ("t", "raw_t")


def cumulative(samples: DataFrame) -> DataFrame:
    """samples with ``cum``, the increase since the series' first sample, resets taken out."""
    w = Window.partitionBy("series").orderBy(*_ORDER)
    before = F.lag("v").over(w)
    gain = F.when(before.isNull(), 0).when(F.col("v") >= before, F.col("v") - before).otherwise(F.col("v")).cast("double")
    return samples.withColumn("_gain", gain).withColumn("cum", F.sum("_gain").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gain")


def on_ticks(samples: DataFrame, columns: list[str], step: int, start: int, end: int) -> DataFrame:
    """series, labels, k and ``columns`` interpolated at each tick k * step from start to end.

    Only ticks within the observed range have a row, so a series' rows have consecutive k; a series of one
    sample has none. Each sample owns the ticks behind it up to its successor, and the first its own time too,
    so one pass over the ordered samples makes them all.
    """
    w = Window.partitionBy("series").orderBy(*_ORDER)
    ahead = samples.select(
        "series",
        "labels",
        "t",
        F.row_number().over(w).alias("_i"),
        F.lead("t").over(w).alias("_t2"),
        *columns,
        *[F.lead(c).over(w).alias(f"_{c}2") for c in columns],
    ).where(F.col("_t2").isNotNull())
    behind = F.when((F.col("_i") == 1) & (F.pmod("t", F.lit(step)) == 0), 0).otherwise(1)
    after = F.greatest(F.expr(f"t div {step}") + behind, F.lit(start // step))
    until = F.least(F.expr(f"_t2 div {step}"), F.lit(end // step))
    ticks = ahead.where(after <= until).select("*", F.explode(F.sequence(after, until)).alias("k"))
    at = F.col("k") * step
    share = F.try_divide(at - F.col("t"), F.col("_t2") - F.col("t"))
    between = lambda c: F.col(c) + share * (F.col(f"_{c}2") - F.col(c))
    exact = lambda c: F.when(at == F.col("t"), F.col(c).cast("double")).when(at == F.col("_t2"), F.col(f"_{c}2").cast("double"))
    value = lambda c: exact(c).otherwise(between(c))
    return ticks.select("series", "labels", "k", *[value(c).alias(c) for c in columns])


def rate(samples: DataFrame, step: int, start: int, end: int, range_ns: int = 0) -> DataFrame:
    """Points at the multiples of ``step`` from ``start`` (rounded down) to ``end``: the increase per second
    over the step before, between values interpolated at both ends.

    Samples are read from the larger of step and range before the start. A tick without a sample on either
    side of both ends has no point. With read windows, a point has the band of the slowest and fastest rate
    that the windows, interpolated alike, allow, and their edges.
    """
    if step <= 0:
        raise ValueError("the step has to be positive")
    start = floor_step(start, step)
    read = as_samples(samples).where(F.col("raw_t").between(start - max(range_ns, step), end) & F.col("v").isNotNull())
    # Rates need no more of a read's window than its distance from the sample; distances keep doubles exact.
    read = read.withColumns({"b": F.col("w_begin") - F.col("t"), "e": F.col("w_end") - F.col("t")})
    ticks = on_ticks(cumulative(read), ["cum", "b", "e"], step, start - step, end)
    w = Window.partitionBy("series").orderBy("k")
    prior = {f"{c}0": F.lag(c).over(w) for c in ("cum", "b", "e")}
    pairs = ticks.withColumns(prior).where(F.col("cum0").isNotNull() & F.col("k").between(start // step, end // step))
    gain = F.col("cum") - F.col("cum0")
    v = gain / (step / SECOND)
    longest = (F.col("e") - F.col("b0") + step) / SECOND
    shortest = (F.col("b") - F.col("e0") + step) / SECOND
    known = F.col("b").isNotNull() & F.col("b0").isNotNull() & (longest > 0) & (shortest > 0)
    t = F.col("k") * step
    out = pairs.select(
        "series",
        "labels",
        t.alias("t"),
        v.alias("v"),
        F.when(known, F.least(F.try_divide(gain, longest), v)).alias("lo"),
        F.when(known, F.greatest(F.try_divide(gain, shortest), v)).alias("hi"),
        F.when(known, F.col("b0") + (t - step)).alias("e_lb"),
        F.when(known, F.col("e0") + (t - step)).alias("e_le"),
        F.when(known, F.col("b") + t).alias("e_rb"),
        F.when(known, F.col("e") + t).alias("e_re"),
    )
    return as_points(out)


def _pairwise(samples: DataFrame, t: Column) -> DataFrame:
    """series, labels, t and v: the rate between every two consecutive samples, at the later one."""
    w = Window.partitionBy("series").orderBy(*_ORDER)
    gap = t - F.lag(t).over(w)
    before = F.lag("v").over(w)
    gain = F.when(F.col("v") >= before, F.col("v") - before).otherwise(F.col("v")).cast("double")
    return samples.select("series", "labels", t.alias("t"), gain.alias("_g"), gap.alias("_d")).where("_d > 0").select(
        "series", "labels", "t", (F.col("_g") / (F.col("_d") / SECOND)).alias("v")
    )


def raw_rate(samples: DataFrame, start: int, end: int, range_ns: int = 0) -> DataFrame:
    """Points at the samples' own times from start to end: the rate since the sample before."""
    read = as_samples(samples).where(F.col("raw_t").between(start - range_ns, end) & F.col("v").isNotNull())
    return as_points(_pairwise(read, F.col("raw_t")).where(F.col("t").between(start, end)))


def second_derivative(samples: DataFrame, step: int, start: int, end: int, on_grid: bool = True) -> DataFrame:
    """At each tick the slope of the pairwise rates from two steps before to one after, by least squares.

    Time is taken relative to the tick, so that slopes are exact at times since the epoch.
    """
    start = floor_step(start, step) if on_grid else start
    read = as_samples(samples).where(F.col("raw_t").between(start - 2 * step, end) & F.col("v").isNotNull())
    return slopes(_pairwise(read, F.col("t")), step, start, end)


def slopes(points: DataFrame, step: int, start: int, end: int) -> DataFrame:
    """The least-squares slope, per second, of (t, v) within [tick - 2 steps, tick + step] at each tick with two or more."""
    near = points.withColumns({"_lo": F.greatest(F.col("t") - step - start, F.lit(0)), "_hi": F.least(F.col("t") + 2 * step, F.lit(end)) - start})
    first, last = F.expr(f"(_lo + {step - 1}) div {step}"), F.expr(f"_hi div {step}")
    near = near.where((F.col("_hi") >= 0) & (first <= last)).select("*", F.explode(F.sequence(first, last)).alias("_k"))
    tick = F.col("_k") * step + start
    x = (F.col("t") - tick) / SECOND
    # Labels are a key: a map among the aggregates would have every sample sorted instead of hashed, once for each tick.
    fitted = near.groupBy("series", F.array_sort(F.map_entries("labels")).alias("_labels"), tick.alias("at")).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(F.col("v").cast("double"), x).alias("v")
    )
    labels = F.map_from_entries("_labels").alias("labels")
    out = fitted.where("_n >= 2").select("series", labels, F.col("at").alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"))
    return as_points(out)
