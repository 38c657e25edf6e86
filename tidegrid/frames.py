"""The two shapes of DataFrame that the metric operators take and return.

samples: a row per sample of a counter or gauge
    series string (identity), labels map<string,string>, t long (ns, on the sampling grid), raw_t long (ns as
    recorded), v (the value), w_begin and w_end long (when it was read, in ns; null if unknown)
points: a row per evaluated point
    series, labels, t, v double, lo and hi double (uncertainty band, null if none), e_lb, e_le, e_rb, e_re
    double (begin and end of the reads that the band's left and right edge come from; null if none)

Both are partitioned by series wherever order matters; no operator needs one row per series or an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000
BAND = ["lo", "hi"]
EDGES = ["e_lb", "e_le", "e_rb", "e_re"]
POINT = ["series", "labels", "t", "v", *BAND, *EDGES]


def as_points(df: DataFrame) -> DataFrame:
    """``df`` with the columns of points; those of the band and its edges that it lacks are null."""
    missing = {c: F.lit(None).cast("double") for c in BAND + EDGES if c not in df.columns}
    return df.withColumns(missing).withColumn("v", F.col("v").cast("double")).select(*POINT)


def as_samples(df: DataFrame) -> DataFrame:
    """``df`` with the columns of samples; raw_t is t, and the read's window null, where it lacks them."""
    extra = {}
    if "raw_t" not in df.columns:
        extra["raw_t"] = F.col("t")
    for c in ("w_begin", "w_end"):
        if c not in df.columns:
            extra[c] = F.lit(None).cast("long")
    return df.withColumns(extra).select("series", "labels", "t", "raw_t", "v", "w_begin", "w_end")


def floor_step(at: int, step: int) -> int:
    """The last multiple of ``step`` up to ``at``: grids start at multiples of the step since the epoch."""
    return at // step * step if step else at
