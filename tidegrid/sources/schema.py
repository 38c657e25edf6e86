"""What a source holds: names, labels, counts and times, from its catalog or its long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import labels as L


def names(catalog: DataFrame, kind: str | None = None) -> DataFrame:
    """kind, metric: sorted, each once."""
    return (catalog if kind is None else catalog.where(F.col("kind") == kind)).select("kind", "metric").distinct().orderBy("metric", "kind")


def label_sets(catalog: DataFrame, metric: str, kind: str | None = None) -> DataFrame:
    """series, labels of a metric, sorted, each once."""
    own = catalog.where(F.col("metric") == metric)
    own = own if kind is None else own.where(F.col("kind") == kind)
    return own.groupBy("series").agg(F.first("labels").alias("labels")).orderBy("series")


def label_values(catalog: DataFrame, metric: str | None = None) -> DataFrame:
    """label, value: of a metric, or of all."""
    own = catalog if metric is None else catalog.where(F.col("metric") == metric)
    return own.select(F.explode("labels").alias("label", "value")).distinct().orderBy("label", "value")


def series_count(catalog: DataFrame) -> DataFrame:
    """kind, metric, n: how many series."""
    return catalog.groupBy("kind", "metric").agg(F.countDistinct("series").alias("n"))


def has(catalog: DataFrame, metric: str, kind: str | None = None) -> bool:
    return not label_sets(catalog, metric, kind).isEmpty()


def columns(catalog: DataFrame, matchers: list[tuple[str, str, str]], metric: str | None = None) -> DataFrame:
    """column_name of the physical columns that a selection reads; ``metric`` is a pattern of Java's, anchored."""
    own = catalog if metric is None else catalog.where(F.col("metric").rlike(f"^(?:{metric})$"))
    return own.where(L.matches(F.col("labels"), matchers)).select("column_name").distinct().orderBy("column_name")


def time_range(rows: DataFrame) -> DataFrame:
    """first_ns and last_ns as recorded; Spark answers this from the files' statistics where it can."""
    return rows.agg(F.min("raw_t").alias("first_ns"), F.max("raw_t").alias("last_ns"))


def sample_times(rows: DataFrame) -> DataFrame:
    """file_id, raw_t: every tick's own time, sorted."""
    return rows.select("file_id", "raw_t").where("raw_t is not null").distinct().orderBy("file_id", "raw_t")


def select(rows: DataFrame, kind: str, metric: str, matchers: list[tuple[str, str, str]] | None = None, check: bool = True) -> DataFrame:
    """The rows of a metric whose labels match.

    Raises KeyError where there is none of that name and kind, which takes a job that stops at the first row;
    without ``check`` the result is then empty.
    """
    own = rows.where((F.col("kind") == kind) & (F.col("metric") == metric))
    found = own.where(L.matches(F.col("labels"), matchers or []))
    if check and found.isEmpty():
        raise KeyError(f"no {kind} {metric}")
    return found


def latest(points: DataFrame) -> DataFrame:
    """The last point of each series, as an instant query gives it."""
    top = F.max(F.struct("t", "v", "lo", "hi")).alias("_p")
    return points.groupBy("series").agg(F.first("labels").alias("labels"), top).select("series", "labels", "_p.*")
