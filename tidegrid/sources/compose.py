"""Several sources as one: side by side, spliced in time, or by metric. All work on long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions import labels as L
from tidegrid.sources.recording import FILE, Recording


def labelled(rows: DataFrame, **labels: str) -> DataFrame:
    """``rows`` with labels put onto every series."""
    more = F.create_map(*[F.lit(x) for kv in sorted(labels.items()) for x in kv])
    all_labels = F.map_concat(L.drop(F.col("labels"), list(labels)), more)
    return rows.withColumn("labels", all_labels).withColumn("series", L.canonical(F.col("labels")))


def side_by_side(*tables: DataFrame) -> DataFrame:
    """Sources that may hold series of equal labels. Counters and gauges stay series of their own, told apart
    by their source; histograms of equal labels are one series."""
    if not tables:
        raise ValueError("no sources")
    out = None
    for i, t in enumerate(tables):
        own = F.concat(F.col("series"), F.lit(f"#{i:06d}"))
        kept = t.withColumn("series", F.when(F.col("kind") == "histogram", F.col("series")).otherwise(own)).withColumn(FILE, F.lit(i))
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out


def spliced(*tables: DataFrame) -> DataFrame:
    """Segments of one recording: series of equal labels are one series throughout.

    A series of which some rows have read windows and some haven't loses them all. Histograms whose bucket
    layout changes between segments get a label ``__run__``, counted from the layout seen first.
    """
    if not tables:
        raise ValueError("no sources")
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn(FILE, F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    known = F.col("w_begin").isNotNull()
    per = out.groupBy("kind", "metric", "series").agg(F.min(known).alias("_all"), F.max(known).alias("_some"))
    mixed = per.where("_some and not _all").select("kind", "metric", "series", F.lit(True).alias("_mixed"))  # most often none
    out = out.join(mixed, ["kind", "metric", "series"], "left")
    out = out.withColumns({c: F.when(F.col("_mixed").isNull(), F.col(c)) for c in ("w_begin", "w_end")}).drop("_mixed")
    if "p" not in out.columns:  # counters and gauges alone
        return out
    layout = out.where("kind = 'histogram'").groupBy("metric", "p", "n").agg(F.min(FILE).alias("_since"))
    by = Window.partitionBy("metric").orderBy("_since", "p", "n")
    runs = layout.select("metric", "p", "n", (F.row_number().over(by) - 1).alias("_run"), F.count("p").over(Window.partitionBy("metric")).alias("_runs"))
    numbered = out.join(F.broadcast(runs.where("_runs > 1").drop("_runs")), ["metric", "p", "n"], "left")
    with_run = F.map_concat("labels", F.create_map(F.lit("__run__"), F.col("_run").cast("string")))
    numbered = numbered.withColumn("labels", F.when(F.col("_run").isNull(), F.col("labels")).otherwise(with_run)).drop("_run")
    return numbered.withColumn("series", L.canonical(F.col("labels")))


def one_run(rows: DataFrame, run: int | None = None) -> DataFrame:
    """The histograms of one bucket layout: the first by default. The label ``__run__`` is taken off again."""
    held = F.coalesce(F.col("labels")["__run__"], F.lit("0")) == str(run or 0)
    bare = L.drop(F.col("labels"), ["__run__"])
    return rows.where(held).withColumn("labels", bare).withColumn("series", L.canonical(bare))


def overlaps(*sources: list[Recording]) -> list[str]:
    """Names (with kind) that several sources hold, sorted."""
    seen: dict[str, int] = {}
    for recordings in sources:
        for name in {f"{c.kind} {c.metric}" for r in recordings for c in r.columns}:
            seen[name] = seen.get(name, 0) + 1
    return sorted(k for k, n in seen.items() if n > 1)


def disjoint(*tables: DataFrame, strict: bool = True) -> DataFrame:
    """Sources of different metrics. A (kind, metric) belongs to the first source that holds it; with
    ``strict``, several holding one is an error that names them."""
    if not tables:
        raise ValueError("no sources")
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn(FILE, F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    owners = out.groupBy("kind", "metric").agg(F.min(FILE).alias("_own"), F.max(FILE).alias("_last"))
    if strict:
        shared = [f"{r['kind']} {r['metric']}" for r in owners.where("_own < _last").orderBy("kind", "metric").collect()]
        if shared:
            raise ValueError(f"sources aren't disjoint: {', '.join(shared)}")
        return out
    return out.join(F.broadcast(owners.drop("_last")), ["kind", "metric"]).where(F.col(FILE) == F.col("_own")).drop("_own")


def finest_interval(*intervals: int) -> int:
    return min(intervals, default=1_000_000_000)
