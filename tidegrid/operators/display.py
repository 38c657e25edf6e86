"""Long series as boxes of a width that people read easily, without hiding spikes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.frames import SECOND, as_points

# Widths of a box in seconds, up to a day; beyond, whole days.
WIDTHS = [1, 2, 5, 10, 15, 20, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400]

BANDS = {"iqr": (0.25, 0.75), "wide": (0.1, 0.9)}


def box_width(span_seconds: Column, budget: int) -> Column:
    raw = span_seconds / budget
    out = F.ceil(raw / WIDTHS[-1]) * WIDTHS[-1]
    for w in reversed(WIDTHS):
        out = F.when(raw <= w, w).otherwise(out)
    return out.cast("long")


def boxplot(points: DataFrame, budget: int, band: str | tuple[float, float] = "iqr", native_ns: int | None = None) -> DataFrame:
    """series, t, min, lo, median, hi, max, unc_lo, unc_hi, n, and where they come from: decimated, raw_points
    (of the series), reducer, band_low and band_high (the quantiles of lo and hi), native_interval (seconds
    between the points that were evaluated, ``native_ns``).

    A series of at most ``budget`` points (or any, for 0) stays as it is, each point its own box. Otherwise
    boxes start at multiples of their width since the epoch and hold what lies in them. lo and hi are the
    band's quantiles, by linear interpolation; unc_lo and unc_hi are the medians of the uncertainty bands,
    for series all of whose points have one.
    """
    low, high = BANDS[band] if isinstance(band, str) else band
    df = as_points(points)
    per = df.groupBy("series").agg(
        F.count(F.lit(1)).alias("_n"), F.min("t").alias("_a"), F.max("t").alias("_z"), F.min(F.col("lo").isNotNull() & F.col("hi").isNotNull()).alias("_banded")
    )
    many = (F.lit(budget) > 0) & (F.col("_n") > budget)
    width = box_width((F.col("_z") - F.col("_a")) / SECOND, max(1, budget)) * SECOND
    per = per.select("series", "_banded", F.col("_n").alias("raw_points"), many.alias("decimated"), F.when(many, width).otherwise(1).alias("_w"))
    marked = df.join(per, "series").withColumn("_at", (F.col("t") - F.pmod("t", "_w")))
    unc = lambda c: F.when(F.col("_banded"), F.col(c))
    out = marked.groupBy("series", "_at", "decimated", "raw_points").agg(
        F.first("labels").alias("labels"),
        F.min("v").alias("min"),
        F.percentile("v", low).alias("lo"),
        F.percentile("v", 0.5).alias("median"),
        F.percentile("v", high).alias("hi"),
        F.max("v").alias("max"),
        F.percentile(unc("lo"), 0.5).alias("unc_lo"),
        F.percentile(unc("hi"), 0.5).alias("unc_hi"),
        F.count(F.lit(1)).alias("n"),
    )
    origin = {"reducer": F.lit("boxplot"), "band_low": F.lit(float(low)), "band_high": F.lit(float(high))}
    native = F.lit(None if native_ns is None else native_ns / SECOND).cast("double")
    return out.withColumnRenamed("_at", "t").withColumns(origin | {"native_interval": native})
