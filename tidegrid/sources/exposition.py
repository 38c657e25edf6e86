"""Long tables as lines of the Prometheus text format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import h2


def _clean(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_:]", "_")


def _label_text(labels: Column, extra: Column | None = None) -> Column:
    pairs = F.transform(
        F.array_sort(F.map_entries(labels)),
        lambda e: F.concat(F.regexp_replace(e["key"], r"[^A-Za-z0-9_]", "_"), F.lit('="'), F.regexp_replace(e["value"], r'([\\"])', r"\\$1"), F.lit('"')),
    )
    joined = F.array_join(pairs if extra is None else F.concat(pairs, F.array(extra)), ",")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("{"), joined, F.lit("}")))


def _quantile_lines(hist: DataFrame, qs: list[float], p: int, n: Column, stamp: Column) -> DataFrame:
    """The line of each quantile: the end of the first bucket with max(1, ceil(q * n)) events up to it."""
    step = lambda a, b: F.concat(a, F.array(F.struct(b["idx"].alias("idx"), (F.coalesce(F.element_at(a, -1)["upto"], F.lit(0)) + b["cnt"]).alias("upto"))))
    none = F.array().cast("array<struct<idx:int,upto:bigint>>")
    upto = F.aggregate(F.array_sort("_s.buckets"), none, lambda a, b: F.when(F.size(a) > 0, step(a, b)).otherwise(F.array(F.struct(b["idx"].alias("idx"), b["cnt"].alias("upto")))))
    asked = F.array(*[F.struct(F.lit(str(q)).alias("text"), F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * n)).alias("rank")) for q in qs])
    each = hist.withColumns({"_n": n, "_u": upto}).where("_n > 0").withColumn("_q", F.explode(asked))
    top = F.element_at(F.filter("_u", lambda u: u["upto"] >= F.col("_q.rank")), 1)["idx"]
    said = F.concat(F.lit('quantile="'), F.col("_q.text"), F.lit('"'))
    line = F.concat_ws(" ", F.concat(_clean(F.col("metric")), _label_text(F.col("labels"), said)), h2.bucket_end(top, p).cast("string"), stamp)
    return each.select("metric", F.lit(1).alias("place"), line.alias("line"))


def lines(rows: DataFrame, p: int = 3, percentiles: list[float] | None = None) -> DataFrame:
    """metric, place and line of the latest sample of each series; histograms as _bucket, _sum and _count.

    percentiles (0 to 1): write histograms as summaries instead, the upper bound of the bucket that holds each
    as the line of its quantile, and _sum and _count; one without events has these two alone.
    Lines of one metric follow its TYPE line when ordered by (metric, place).
    """
    last = rows.groupBy("kind", "metric", "series").agg(F.first("labels").alias("labels"), F.max(F.struct("t", "v", "buckets")).alias("_s"))
    name, stamp = _clean(F.col("metric")), F.expr("_s.t div 1000000").cast("string")
    put = lambda *c: F.concat_ws(" ", *c)
    plain = last.where("kind <> 'histogram'").select("metric", F.lit(1).alias("place"), put(F.concat(name, _label_text(F.col("labels"))), F.col("_s.v").cast("string"), stamp).alias("line"))
    each = last.where("kind = 'histogram'").select("metric", "labels", F.col("_s.t").alias("t"), F.posexplode("_s.buckets").alias("_i", "_b"), "_s.buckets")
    upto = F.aggregate(F.slice("buckets", 1, F.col("_i") + 1), F.lit(0).cast("long"), lambda a, b: a + b["cnt"])
    le = F.concat(F.lit('le="'), h2.bucket_end(F.col("_b.idx"), p).cast("string"), F.lit('"'))
    stamp2 = F.expr("t div 1000000").cast("string")
    bars = each.select("metric", F.lit(1).alias("place"), put(F.concat(_clean(F.col("metric")), F.lit("_bucket"), _label_text(F.col("labels"), le)), upto.cast("string"), stamp2).alias("line"))
    hist = last.where("kind = 'histogram'")
    n = F.aggregate("_s.buckets", F.lit(0).cast("long"), lambda a, b: a + b["cnt"])
    total = F.aggregate("_s.buckets", F.lit(0).cast("long"), lambda a, b: a + b["cnt"] * F.floor((h2.bucket_start(b["idx"], p) + h2.bucket_end(b["idx"], p)) / 2))
    inf = F.lit('le="+Inf"')
    tops = [("_bucket", _label_text(F.col("labels"), inf), n)]
    if percentiles is not None:
        bars = _quantile_lines(hist, percentiles, p, n, stamp)
        tops = []
    ends = [*tops, ("_sum", _label_text(F.col("labels")), total), ("_count", _label_text(F.col("labels")), n)]
    out = plain.unionByName(bars)
    for suffix, text, value in ends:
        out = out.unionByName(hist.select("metric", F.lit(2).alias("place"), put(F.concat(name, F.lit(suffix), text), value.cast("string"), stamp).alias("line")))
    shown = F.when((F.col("kind") == "histogram") & F.lit(percentiles is not None), "summary").otherwise(F.col("kind"))
    kinds = last.groupBy("metric", "kind").agg(F.lit(0).alias("place")).select("metric", "place", put(F.lit("# TYPE"), name, shown).alias("line"))
    return out.unionByName(kinds)
