"""Gauges: the last value, means and differences over a range, and slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.frames import as_points, as_samples, floor_step
from tidegrid.operators.counters import slopes


def _read(samples: DataFrame, start: int, end: int, back: int) -> DataFrame:
    return as_samples(samples).where(F.col("raw_t").between(start - back, end) & F.col("v").isNotNull())


def _spread(df: DataFrame, low: Column, high: Column, step: int, start: int, end: int) -> DataFrame:
    """A row for each tick start + k * step up to ``end`` that lies within [low, high], as column ``at``."""
    marked = df.withColumns({"_lo": F.greatest(low - start, F.lit(0)), "_hi": F.least(high, F.lit(end)) - start})
    first, last = F.expr(f"(_lo + {step - 1}) div {step}"), F.expr(f"_hi div {step}")
    some = marked.where((F.col("_hi") >= 0) & (first <= last))
    return some.withColumn("_k", F.explode(F.sequence(first, last))).withColumn("at", F.col("_k") * step + start).drop("_lo", "_hi", "_k")


def _asof(read: DataFrame) -> DataFrame:
    """Samples with the time of their successor; of equal times the last holds."""
    w = Window.partitionBy("series").orderBy("t", "raw_t")
    return read.withColumns({"_next": F.lead("t").over(w), "_t0": F.lag("t").over(w), "_v0": F.lag("v").over(w)})


def last(samples: DataFrame, step: int, start: int, end: int, interval: int) -> DataFrame:
    """At each multiple of ``step`` the last value, if it is no older than the larger of step and interval."""
    start, stale = floor_step(start, step), max(step, interval)
    held = _asof(_read(samples, start, end, stale))
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("t") + stale), F.col("t") + stale)
    return as_points(_spread(held, F.col("t"), until, step, start, end).select("series", "labels", F.col("at").alias("t"), "v"))


def raw(samples: DataFrame, step: int, start: int, end: int, interval: int) -> DataFrame:
    """The samples themselves at their own times; those within the staleness before the start are among them."""
    read = _read(samples, start, end, max(step, interval))
    return as_points(read.select("series", "labels", F.col("raw_t").alias("t"), "v"))


def avg_over_time(samples: DataFrame, range_ns: int, step: int, start: int, end: int, on_grid: bool = True) -> DataFrame:
    """The mean of the samples within [tick - range, tick], both ends included."""
    if not on_grid:
        read = _read(samples, start, end, range_ns)
        w = Window.partitionBy("series").orderBy("raw_t").rangeBetween(-range_ns, 0)
        return as_points(read.select("series", "labels", F.col("raw_t").alias("t"), F.avg("v").over(w).alias("v")))
    start = floor_step(start, step)
    near = _spread(_read(samples, start, end, range_ns), F.col("t"), F.col("t") + range_ns, step, start, end)
    means = near.groupBy("series", "at").agg(F.first("labels").alias("labels"), F.avg("v").alias("v"))
    return as_points(means.withColumnRenamed("at", "t"))


def idelta(samples: DataFrame, range_ns: int, step: int, start: int, end: int) -> DataFrame:
    """The difference of the last two samples within [tick - range, tick]."""
    start = floor_step(start, step)
    held = _asof(_read(samples, start, end, range_ns)).where(F.col("_t0").isNotNull())
    until = F.least(F.coalesce(F.col("_next") - 1, F.lit(end)), F.col("_t0") + range_ns)
    at = _spread(held, F.col("t"), until, step, start, end)
    return as_points(at.select("series", "labels", F.col("at").alias("t"), (F.col("v") - F.col("_v0")).alias("v")))


def deriv(samples: DataFrame, step: int, start: int, end: int, range_ns: int = 0) -> DataFrame:
    """The least-squares slope per second of the samples from two steps before each tick to one after."""
    start = floor_step(start, step)
    read = _read(samples, start, end, max(range_ns, 2 * step))
    return slopes(read.select("series", "labels", "t", "v"), step, start, end)
