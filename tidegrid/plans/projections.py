"""The relational test tables seen as metrics: long tables of counters, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions import labels as L
from tidegrid.operators import histogram

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
GROUPING_POWER = 4


def nanos(column: str) -> Column:
    """A timestamp without time zone in ns since the epoch."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, cast({column} as timestamp_ntz)) * 1000")


def span(spark: SparkSession, sf_dir: str, table: str, column: str) -> tuple[int, int]:
    """First and last time of a table in ns, one row to the driver; (0, 0) where it has none."""
    ends = spark.read.parquet(f"{sf_dir}/{table}.parquet").agg(F.min(nanos(column)).alias("a"), F.max(nanos(column)).alias("z")).first()
    return (0, 0) if ends["a"] is None else (ends["a"], ends["z"])


def grid_span(spark: SparkSession, sf_dir: str, table: str, column: str, step: int) -> tuple[int, int]:
    """The ticks between which all of a table lies."""
    first, last = span(spark, sf_dir, table, column)
    return first - first % step, last - last % step + step


def _labels(*names: str) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


def _long(df: DataFrame, kind: str, metric: str) -> DataFrame:
    out = df.withColumns({"kind": F.lit(kind), "metric": F.lit(metric), "series": L.canonical(F.col("labels")), "raw_t": F.col("t")})
    for c in ("w_begin", "w_end"):
        if c not in df.columns:
            out = out.withColumn(c, F.lit(None).cast("long"))
    return out.select("kind", "metric", "series", "labels", "t", "raw_t", F.col("v").cast("long").alias("v"), "w_begin", "w_end")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", "event_type", "value", nanos("ts").alias("t"))


def _by_type() -> WindowSpec:
    return Window.partitionBy("event_type").orderBy("t", "event_id")


def events_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter of events by type, with the window in which each was read."""
    begin = F.col("t") - F.col("event_id") % 7 * 1_000_000
    e = _events(spark, sf_dir).select(
        _labels("event_type").alias("labels"), "t", F.row_number().over(_by_type()).alias("v"),
        begin.alias("w_begin"), (begin + (F.col("event_id") % 5 + 1) * 1_000_000).alias("w_end"),
    )
    return _long(e, "counter", "events_total")


def wrapped_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counter, starting anew every 50 events."""
    e = _events(spark, sf_dir).select(_labels("event_type").alias("labels"), "t", (F.row_number().over(_by_type()) % 50).alias("v"))
    return _long(e, "counter", "events_wrapped_total")


def revenue_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter of cents by type."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).over(_by_type().rowsBetween(Window.unboundedPreceding, 0))
    e = _events(spark, sf_dir).select(_labels("event_type").alias("labels"), "t", cents.alias("v"))
    return _long(e, "counter", "revenue_cents_total")


def event_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge of the last value, in cents, by type and user."""
    e = _events(spark, sf_dir).select(_labels("event_type", "user_id").alias("labels"), "t", F.round(F.col("value") * 100).cast("long").alias("v"))
    return _long(e, "gauge", "event_value")


def type_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge of the last value, in cents, by type."""
    e = _events(spark, sf_dir).select(_labels("event_type").alias("labels"), "t", F.round(F.col("value") * 100).cast("long").alias("v"))
    return _long(e, "gauge", "type_value")


def last_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge of a single series: one more than the id of the last user seen."""
    e = _events(spark, sf_dir).select(F.create_map(F.lit("scope"), F.lit("site")).alias("labels"), "t", (F.col("user_id") + 1).alias("v"))
    return _long(e, "gauge", "last_user")


def events_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter of events by type and by the users' remainder of three."""
    e = _events(spark, sf_dir).withColumn("shard", F.col("user_id") % 3)
    n = F.row_number().over(Window.partitionBy("event_type", "shard").orderBy("t", "event_id"))
    return _long(e.select(_labels("event_type", "shard").alias("labels"), "t", n.alias("v")), "counter", "events_by_shard")


def revenue_by_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter of cents by type and by the users' remainder of three."""
    e = _events(spark, sf_dir).withColumn("shard", F.col("user_id") % 3)
    w = Window.partitionBy("event_type", "shard").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).over(w)
    return _long(e.select(_labels("event_type", "shard").alias("labels"), "t", cents.alias("v")), "counter", "revenue_by_shard")


def slow_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times the events by type, read in windows of tens of minutes."""
    begin = F.col("t") - F.col("event_id") % 4 * 600_000_000_000
    e = _events(spark, sf_dir).select(
        _labels("event_type").alias("labels"), "t", (F.row_number().over(_by_type()) * 3).alias("v"),
        begin.alias("w_begin"), (begin + (F.col("event_id") % 6 + 2) * 600_000_000_000).alias("w_end"),
    )
    return _long(e, "counter", "slow_total")


def third_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge: the last value's remainder of three, by type."""
    return type_value(spark, sf_dir).withColumns({"v": F.col("v") % 3, "metric": F.lit("third_value")})


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"t": nanos("o_orderdate"), "value": F.floor("o_totalprice")})


def shop_price(spark: SparkSession, sf_dir: str, p: int = GROUPING_POWER, half: int | None = None) -> DataFrame:
    """Long table of one histogram of all order prices; a tick is a day with orders, of the first or second half alone."""
    rows = _orders(spark, sf_dir)
    if half is not None:
        first, last = span(spark, sf_dir, "orders", "o_orderdate")
        rows = rows.where(F.col("t") < (first + last) // 2 if half == 0 else F.col("t") >= (first + last) // 2)
    made = histogram.from_values(rows.select("t", "value"), p, F.create_map(F.lit("shop"), F.lit("all")))
    none = F.lit(None).cast("long")
    return made.withColumns({"kind": F.lit("histogram"), "metric": F.lit("price"), "raw_t": F.col("t"), "v": none, "w_begin": none, "w_end": none, "p": F.lit(p), "n": F.lit(64)})


def status_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of order prices by priority and status."""
    rows = _orders(spark, sf_dir).select("o_orderpriority", "o_orderstatus", "t", "value")
    return histogram.from_values(rows, GROUPING_POWER, _labels("o_orderpriority", "o_orderstatus"))


def order_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of order prices by priority; a tick is a day with orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", nanos("o_orderdate").alias("t"), F.floor("o_totalprice").alias("value"))
    return histogram.from_values(o, GROUPING_POWER, _labels("o_orderpriority"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points: orders a day by priority, with a made-up band of one up and down."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", nanos("o_orderdate").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    o = o.withColumns({"labels": _labels("o_orderpriority"), "lo": F.col("v") - 1, "hi": F.col("v") + 1})
    return o.withColumn("series", L.canonical(F.col("labels"))).drop("o_orderpriority")
