"""What several operators need: cut lineage, and number rows without one large task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with at least one in so many of all rows is joined by broadcast; there are no more than so many.
HOT_SHARE = 1_000

_OWN_DIRS: dict[str, str] = {}

#: Rows that one window partition of ``number_rows`` holds on average at most, and how many there are at least,
#: so that tasks get about as many rows each.
ROWS_PER_BUCKET, MIN_BUCKETS = 20_000, 1_024


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):  # a cluster without the setting: beside its tables
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, exact size statistics."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(n_rows: int, *spread: Column) -> Column:
    """A hash bucket of ROWS_PER_BUCKET rows or less; equal ``spread`` values share one."""
    return F.pmod(F.xxhash64(*spread), F.lit(max(MIN_BUCKETS, -(-n_rows // ROWS_PER_BUCKET))))


def number_rows(
    df: DataFrame, name: str, n_rows: int, groups: list[str], spread: list[Column], first: Column | None = None
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps within each group.

    Rows are ordered by ``first``, then by the hash of ``spread``, then by ``spread`` itself. Each window
    holds one hash bucket, so a group of any size is numbered by many tasks; ``spread`` has to differ
    between most rows. Rows with equal ``spread`` get an arbitrary order among themselves.
    """
    keyed = df.withColumn("_lead", F.lit(0) if first is None else first).withColumn("_bucket", bucket_of(n_rows, *spread))
    keys = [*groups, "_lead", "_bucket"]
    upto = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_lead", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*keys, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*keys).orderBy(*spread)
    return (
        keyed.join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .drop("_lead", "_bucket", "_offset")
    )


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key`` and, in ``count``, how many rows have it.

    Keys with a thousandth of all ``total`` rows or more are joined by broadcast where the rows are, so that no
    task gets a hot key's rows; there are a thousand of them at most. The others are shuffled.
    """
    hot = F.broadcast(table.where(F.col(count) * HOT_SHARE >= total))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(count) * HOT_SHARE < total), key))
