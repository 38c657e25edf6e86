"""Aggregation over series at equal times, by label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.frames import as_points
from tidegrid.functions import labels as L

OPS = ("sum", "avg", "min", "max", "count")


def aggregate(points: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """One series for each value of the grouping labels (``by``, or all but ``without``, or none at all).

    sum and avg carry bands (a point without one is exact, if any has one); min, max and count have none. The
    edges of the reads are kept where all contributing points share them. Partial sums are made before the
    shuffle, so a group of any number of series costs a row per task and time.
    """
    if op not in OPS:
        raise ValueError(f"unknown aggregate {op!r}")
    if by is not None and without is not None:
        raise ValueError("either by or without")
    names = F.col("labels")
    group = L.keep(names, by) if by is not None else L.drop(names, without) if without is not None else L.keep(names, [])
    read = F.struct("e_lb", "e_le", "e_rb", "e_re")
    keyed = as_points(points).select(group.alias("labels"), L.canonical(group).alias("series"), "t", "v", "lo", "hi", read.alias("_e"))
    value = {"sum": F.sum("v"), "avg": F.avg("v"), "min": F.min("v"), "max": F.max("v"), "count": F.count("v").cast("double")}[op]
    has = F.max(F.col("lo").isNotNull())
    out = keyed.groupBy("series", "t").agg(
        F.first("labels").alias("labels"),
        value.alias("v"),
        F.when(has, F.sum(F.coalesce("lo", "v"))).alias("lo"),
        F.when(has, F.sum(F.coalesce("hi", "v"))).alias("hi"),
        F.count("v").alias("_n"),
        F.count("_e.e_lb").alias("_edged"),
        F.min("_e").alias("_e0"),
        F.max("_e").alias("_e1"),
    )
    scale = {"sum": F.lit(1), "avg": F.col("_n")}.get(op)
    for c in ("lo", "hi"):
        out = out.withColumn(c, F.lit(None).cast("double") if scale is None else F.col(c) / scale)
    same = (F.col("_edged") == F.col("_n")) & (F.col("_e0") == F.col("_e1"))
    return as_points(out.withColumns({c: F.when(same, F.col(f"_e0.{c}")) for c in ("e_lb", "e_le", "e_rb", "e_re")}))
