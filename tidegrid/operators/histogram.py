"""Histograms recorded cumulatively, a row per series and tick.

histograms: series, labels, t long (ns), buckets array<struct<idx int, cnt long>> (of buckets with a count; an
empty array is a tick that was recorded without any). What happened at a tick is the rise of each bucket since
the series' previous row; a bucket that isn't in the previous row rises from zero, one that falls has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.frames import SECOND, as_points
from tidegrid.functions import h2
from tidegrid.functions import labels as L

_MAP = "map<int,bigint>"


def _with_previous(hist: DataFrame, start: int, end: int) -> DataFrame:
    w = Window.partitionBy("series").orderBy("t")
    read = hist.where(F.col("t").between(start, end)).select("series", "labels", "t", "buckets")
    return read.withColumns({"_prev": F.lag("buckets").over(w), "_seen": F.lag("t").over(w).isNotNull()}).where("_seen").drop("_seen")


def _group(df: DataFrame, by: list[str] | None, without: list[str] | None) -> DataFrame:
    names = F.col("labels")
    group = L.keep(names, by) if by is not None else L.drop(names, without) if without is not None else L.keep(names, [])
    return df.withColumn("labels", group).withColumn("series", L.canonical(F.col("labels")))


def deltas(hist: DataFrame, start: int, end: int, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """series, labels, t, idx, cnt: the events of each bucket at each tick, summed over the series of a group.

    Only buckets with events leave a task, summed by group and tick before the shuffle.
    """
    both = _with_previous(hist, start, end).withColumn("_was", F.map_from_entries(F.coalesce("_prev", F.array().cast("array<struct<idx:int,cnt:bigint>>"))))
    each = both.select("series", "labels", "t", "_was", F.explode("buckets").alias("_b"))
    rise = F.col("_b.cnt") - F.coalesce(F.col("_was")[F.col("_b.idx")], F.lit(0))
    risen = each.select("series", "labels", "t", F.col("_b.idx").alias("idx"), rise.alias("cnt")).where("cnt > 0")
    return _group(risen, by, without).groupBy("series", "t", "idx").agg(F.first("labels").alias("labels"), F.sum("cnt").alias("cnt"))


def emit_times(batches: Iterator[tuple[np.ndarray, np.ndarray]], stride: int, only_with_data: bool = False) -> Iterator[tuple[np.ndarray, int]]:
    """(ticks, the time that their events are shown at) for batches (times, whether they have events) in order.

    The first tick starts a stride; a tick at least ``stride`` later ends it, and the last tick ends the rest.
    With ``only_with_data`` a stride that had no events isn't ended. A tick counts whole, whatever the order
    of its series. Held are the ticks of one stride.
    """
    last, waiting, data = None, [], False
    for times, has in batches:
        at = 0
        if last is None and len(times):
            last = int(times[0])
            data = bool(has[0])
            waiting, at = [times[:1]], 1
        busy = np.flatnonzero(has)
        while at < len(times):
            end = max(at, int(np.searchsorted(times, last + stride)))
            if only_with_data and not data:
                after = busy[np.searchsorted(busy, at) :]
                end = max(end, int(after[0])) if len(after) else len(times)
            if end >= len(times):
                waiting.append(times[at:])
                data = data or bool(has[at:].any())
                break
            yield np.concatenate([*waiting, times[at : end + 1]]), int(times[end])
            last, waiting, data, at = int(times[end]), [], False, end + 1
    if waiting and sum(map(len, waiting)):
        rest = np.concatenate(waiting)
        yield rest, int(rest[-1])


def strided(hist: DataFrame, events: DataFrame, start: int, end: int, stride: int, only_with_data: bool = False) -> DataFrame:
    """``events`` (of ``deltas``) with the ticks of each stride put together.

    Where a stride ends depends on the ticks before it, so the distinct ticks of the query, nine bytes each and
    none of the events, pass through one task in order, which holds those of one stride.
    """
    if stride <= 0:
        raise ValueError("the stride has to be positive")
    ticks = hist.where(F.col("t").between(start, end)).select("t", F.lit(False).alias("has")).unionByName(events.select("t", F.lit(True).alias("has")))
    ordered = ticks.groupBy("t").agg(F.max("has").alias("has")).repartition(1).sortWithinPartitions("t")

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = ((b["t"].to_numpy(), b["has"].to_numpy(bool)) for b in batches)
        for some, at in emit_times(arrays, stride, only_with_data):
            yield pd.DataFrame({"t": some, "_at": at})

    moved = events.join(ordered.mapInPandas(shown, "t long, _at long"), "t").groupBy("series", "_at", "idx")
    return moved.agg(F.first("labels").alias("labels"), F.sum("cnt").alias("cnt")).withColumnRenamed("_at", "t")


def _events(hist: DataFrame, start: int, end: int, stride: int | None, by=None, without=None, only_with_data: bool = False) -> DataFrame:
    events = deltas(hist, start, end, by, without)
    return events if stride is None else strided(hist, events, start, end, stride, only_with_data)


def number_text(x: float) -> str:
    """The shortest decimal form: 0.5, 1, 0."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def quantiles(hist: DataFrame, qs: list[float], p: int, start: int, end: int, stride: int | None = None) -> DataFrame:
    """A series for each quantile, labelled ``quantile``, of the events of all series together.

    The value is the upper bound of the first bucket up to which there are max(1, ceil(q * n)) events, and the
    band is that bucket.
    """
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles have to be within 0 and 1")
    events = _events(hist, start, end, stride)
    w = Window.partitionBy("series", "t")
    upto = w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = events.withColumns({"_c": F.sum("cnt").over(upto), "_n": F.sum("cnt").over(w)})
    ranks = F.array(*[F.struct(F.lit(number_text(q)).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("_n"))).alias("rank")) for q in qs])
    hit = summed.select("t", "idx", "_c", "cnt", F.explode(ranks).alias("_q")).where((F.col("_c") >= F.col("_q.rank")) & (F.col("_c") - F.col("cnt") < F.col("_q.rank")))
    labels = F.create_map(F.lit("quantile"), F.col("_q.q"))
    top = h2.bucket_end(F.col("idx"), p).cast("double")
    out = hit.select(L.canonical(labels).alias("series"), labels.alias("labels"), "t", top.alias("v"), h2.bucket_start(F.col("idx"), p).cast("double").alias("lo"), top.alias("hi"))
    return as_points(out)


def _weighted(events: DataFrame, p: int) -> DataFrame:
    cnt, idx = F.col("cnt").cast("double"), F.col("idx")
    return events.groupBy("series", "t").agg(
        F.first("labels").alias("labels"),
        F.sum("cnt").alias("_n"),
        F.sum(cnt * h2.bucket_mid(idx, p)).alias("_sum"),
        F.sum(cnt * h2.bucket_start(idx, p).cast("double")).alias("_lo"),
        F.sum(cnt * h2.bucket_end(idx, p).cast("double")).alias("_hi"),
    )


def mean(hist: DataFrame, p: int, start: int, end: int, stride: int | None = None, by=None, without=None) -> DataFrame:
    """The mean of the events' bucket midpoints; the band is that of their bounds."""
    each = _weighted(_events(hist, start, end, stride, by, without), p)
    return as_points(each.select("series", "labels", "t", (F.col("_sum") / F.col("_n")).alias("v"), (F.col("_lo") / F.col("_n")).alias("lo"), (F.col("_hi") / F.col("_n")).alias("hi")))


def total(hist: DataFrame, p: int, start: int, end: int, stride: int | None = None, by=None, without=None) -> DataFrame:
    """The sum of the events' bucket midpoints, with the band of their bounds."""
    each = _weighted(_events(hist, start, end, stride, by, without), p)
    return as_points(each.select("series", "labels", "t", F.col("_sum").alias("v"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))


def count(hist: DataFrame, start: int, end: int, stride: int | None = None, by=None, without=None) -> DataFrame:
    """The number of events; ticks without any have no point."""
    events = _events(hist, start, end, stride, by, without)
    return as_points(events.groupBy("series", "t").agg(F.first("labels").alias("labels"), F.sum("cnt").cast("double").alias("v")))


def irate(hist: DataFrame, start: int, end: int, by=None, without=None) -> DataFrame:
    """Events per second since the group's previous tick; zero where there were none."""
    size = lambda c: F.aggregate(F.coalesce(F.col(c), F.array().cast("array<struct<idx:int,cnt:bigint>>")), F.lit(0).cast("long"), lambda a, b: a + b["cnt"])
    each = _with_previous(hist, start, end).withColumn("_rise", F.greatest(size("buckets") - size("_prev"), F.lit(0)))
    ticks = _group(each, by, without).groupBy("series", "t").agg(F.first("labels").alias("labels"), F.sum("_rise").alias("_rise"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("series").orderBy("t"))
    out = ticks.withColumn("_d", gap).where("_d > 0")
    return as_points(out.select("series", "labels", "t", (F.col("_rise") / (F.col("_d") / SECOND)).alias("v")))


def heatmap(hist: DataFrame, p: int, start: int, end: int, stride: int | None = None) -> DataFrame:
    """t, idx, bucket_end and cnt of every bucket with events, all series together; a sparse table."""
    events = _events(hist, start, end, stride, only_with_data=True)
    return events.select("t", "idx", h2.bucket_end(F.col("idx"), p).alias("bucket_end"), "cnt")


def from_values(values: DataFrame, p: int, labels: Column) -> DataFrame:
    """histograms of (t, value): the events up to each tick of a series, by bucket.

    Each tick's row holds the series' buckets so far; a row is written where the series has events. A bucket's
    count is put out at every tick from one change to the next, so rows made are the buckets written.
    """
    keyed = values.select(L.canonical(labels).alias("series"), labels.alias("labels"), "t", h2.bucket_index(F.col("value"), p).alias("idx"))
    per = keyed.groupBy("series", "t", "idx").agg(F.first("labels").alias("labels"), F.count(F.lit(1)).alias("n"))
    series, bucket = Window.partitionBy("series"), Window.partitionBy("series", "idx").orderBy("t")
    numbered = per.withColumn("_i", F.dense_rank().over(series.orderBy("t")))
    ticks = numbered.select("series", "labels", "t", "_i").dropDuplicates(["series", "t"])
    spans = numbered.withColumns({"cnt": F.sum("n").over(bucket), "_next": F.lead("_i").over(bucket), "_last": F.max("_i").over(series)})
    each = spans.select("series", "idx", "cnt", F.explode(F.sequence("_i", F.coalesce(F.col("_next") - 1, F.col("_last")))).alias("_i"))
    rows = each.groupBy("series", "_i").agg(F.array_sort(F.collect_list(F.struct("idx", "cnt"))).alias("buckets"))
    return rows.join(ticks, ["series", "_i"]).select("series", "labels", "t", "buckets")
