"""Queries over recordings, written from the test tables and read back, and over operators that combine them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.frames import SECOND
from tidegrid.functions import uncertainty as U
from tidegrid.operators import aggregate, binary, counters, display, gauges, histogram
from tidegrid.plans import metric_queries as Q
from tidegrid.plans import projections as P
from tidegrid.plans.metric_queries import BY_TYPE, HIGH, HOUR, MID, NS, STEP, TOTAL, TYPE_VALUE, flat, index_sql, last_sql, near_sql, rate_sql
from tidegrid.scratch import new_folder
from tidegrid.sources import compose, exposition, recording, schema, snapshots
from tidegrid.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Recordings are sampled on minutes.
MINUTE = 60 * SECOND
START, END = Q._FIRST - Q._FIRST % STEP, Q._LAST - Q._LAST % STEP + STEP


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def _span(s: SparkSession, d: str) -> tuple[int, int]:
    return P.grid_span(s, d, "events", "ts", STEP)


# ---- recordings ----


def _recording(s: SparkSession, rows: DataFrame, sparse: bool = True) -> recording.Recording:
    path = f"{new_folder(s, 'recording')}/node"
    recording.write_wide(rows, path, MINUTE // 1_000_000, sparse, source="probe", version="1.2")
    return recording.open_recording(path, spark=s)


def _events(s: SparkSession, d: str) -> recording.Recording:
    return _recording(s, P.events_total(s, d).unionByName(P.type_value(s, d)))


def _read(s: SparkSession, d: str, kind: str) -> DataFrame:
    rows = recording.long_table(s, [_events(s, d)], kinds=(kind,))
    return rows.select(F.col("labels")["event_type"].alias("event_type"), "t", "raw_t", "v", "w_begin", "w_end")


_SNAPPED = f"(t + {MINUTE // 2}) // {MINUTE} * {MINUTE}"
_COUNTED = f"SELECT event_type AS k, {NS} AS t, row_number() {BY_TYPE} AS v, event_id % 7 * 1000000 AS a, (event_id % 5 + 1) * 1000000 AS b FROM events"
_ONCE = "QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY v DESC) = 1"
_add(
    "recording_counter_scan",
    lambda s, d: _read(s, d, "counter"),
    f"SELECT k AS event_type, {_SNAPPED} AS t, t AS raw_t, v::BIGINT AS v, t - a AS w_begin, t - a + b AS w_end FROM ({_COUNTED}) {_ONCE}",
)
_add("recording_gauge_scan", lambda s, d: _read(s, d, "gauge").drop("w_begin", "w_end"), f"SELECT k AS event_type, {_SNAPPED} AS t, t AS raw_t, v FROM ({TYPE_VALUE}) {_ONCE}")

_PRICES = f"p AS (SELECT epoch_us(o_orderdate) * 1000 AS t, {index_sql('floor(o_totalprice)::BIGINT')} AS idx FROM orders)"
_UPTO = f"""WITH {_PRICES}, n AS (SELECT t, idx, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT x.t, y.idx, coalesce(n, 0) AS n FROM (SELECT DISTINCT t FROM p) x CROSS JOIN (SELECT DISTINCT idx FROM p) y LEFT JOIN n ON n.t = x.t AND n.idx = y.idx),
u AS (SELECT t, idx, (sum(n) OVER (PARTITION BY idx ORDER BY t))::BIGINT AS cnt FROM g)
SELECT t, idx::INTEGER AS idx, cnt FROM u WHERE cnt > 0"""


def _buckets(s: SparkSession, d: str, sparse: bool) -> DataFrame:
    rows = recording.long_table(s, [_recording(s, P.shop_price(s, d), sparse)], kinds=("histogram",))
    return rows.select("raw_t", F.explode("buckets").alias("b")).select(F.col("raw_t").alias("t"), "b.idx", "b.cnt")


_add("recording_histogram_sparse", lambda s, d: _buckets(s, d, True), _UPTO)
_add("recording_histogram_dense", lambda s, d: _buckets(s, d, False), _UPTO)
_add(
    "recording_columns",
    lambda s, d: schema.columns(recording.catalog(s, [_events(s, d)]), [("event_type", "=~", "click|purchase")], "events_.*"),
    "SELECT 'events_total/' || i AS column_name FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)) WHERE event_type IN ('click', 'purchase')",
)
_add(
    "recording_label_sets",
    lambda s, d: schema.label_sets(recording.catalog(s, [_events(s, d)]), "type_value", "gauge").select("series", F.size("labels").alias("n")),
    """SELECT DISTINCT '{"event_type":"' || event_type || '"}' AS series, 1 AS n FROM events""",
)
_add(
    "recording_label_values_all",
    lambda s, d: schema.label_values(recording.catalog(s, [_events(s, d), _recording(s, P.shop_price(s, d))])),
    "SELECT DISTINCT 'event_type' AS label, event_type AS value FROM events UNION ALL SELECT 'shop', 'all'",
)


def _about(s: SparkSession, d: str) -> DataFrame:
    one, other = _events(s, d), 10 * SECOND
    finest = compose.finest_interval(one.interval_ns, other)
    rows = [(one.source, one.version, one.filename, one.metadata["sampling_interval_ms"], one.interval_ns / SECOND, finest / SECOND)]
    return s.createDataFrame(rows, "source string, version string, filename string, sampling_interval_ms string, interval_s double, finest_s double")


_add("recording_metadata", _about, "SELECT 'probe' AS source, '1.2' AS version, 'node' AS filename, '60000' AS sampling_interval_ms, 60.0::DOUBLE AS interval_s, 10.0::DOUBLE AS finest_s")


def _two(s: SparkSession, d: str) -> list[recording.Recording]:
    one = _events(s, d)
    return [recording.open_recording(one.path, i, s).with_labels(zone=z) for i, z in enumerate(("east", "west"))]


_add(
    "recording_sample_times",
    lambda s, d: recording.sample_times(s, _two(s, d)).select("file_id", "raw_t"),
    f"SELECT i::INTEGER AS file_id, t AS raw_t FROM (SELECT DISTINCT {NS} AS t FROM events), (VALUES (0), (1)) AS x(i)",
)
_add(
    "recording_injected_label",
    lambda s, d: recording.long_table(s, [r.matching([("zone", "=", "west"), ("event_type", "!=", "click")]) for r in _two(s, d)], kinds=("gauge",))
    .groupBy("file_id", F.col("labels")["zone"].alias("zone"), F.col("labels")["event_type"].alias("event_type"))
    .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")),
    f"SELECT 1::INTEGER AS file_id, 'west' AS zone, k AS event_type, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT * FROM ({TYPE_VALUE}) {_ONCE}) WHERE k <> 'click' GROUP BY k",
)
_add("recording_time_range", lambda s, d: schema.time_range(recording.long_table(s, [_events(s, d)])), f"SELECT min({NS}) AS first_ns, max({NS}) AS last_ns FROM events")

# ---- snapshots and text ----


def _lines(s: SparkSession, d: str) -> DataFrame:
    """A snapshot in JSON for each event: a counter and a gauge listed flat, and the time that reading took."""
    e = s.read.parquet(f"{d}/events.parquet").withColumn("t", P.nanos("ts"))
    named = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), value.alias("value"), F.create_map(F.lit("kind"), F.col("event_type")).alias("metadata")))
    snap = F.struct(
        F.struct(F.expr("t div 1000000000").alias("secs_since_epoch"), (F.col("t") % SECOND).alias("nanos_since_epoch")).alias("systemtime"),
        F.struct(F.lit(0).alias("secs"), (F.col("event_id") % 9).alias("nanos")).alias("duration"),
        named("ids", F.col("event_id")).alias("counters"),
        named("user", F.col("user_id")).alias("gauges"),
    )
    return e.select(F.to_json(snap).alias("value"))


_add(
    "snapshot_json_scan",
    lambda s, d: snapshots.long_rows(_lines(s, d), MINUTE).select("kind", "metric", F.col("labels")["kind"].alias("event_type"), "t", "raw_t", "v", "w_begin", "w_end"),
    f"""WITH e AS (SELECT *, {NS} AS t FROM events)
SELECT 'counter' AS kind, 'ids' AS metric, event_type, {_SNAPPED} AS t, t AS raw_t, event_id AS v, t AS w_begin, t + event_id % 9 AS w_end FROM e
UNION ALL SELECT 'gauge', 'user', event_type, {_SNAPPED}, t, user_id, t, t + event_id % 9 FROM e""",
)
_LAST_DAY = "(SELECT max(epoch_us(o_orderdate)) // 1000 FROM orders)"
_MIDS = "sum(((low + high) // 2) * n)"
_ENDS = f"b AS (SELECT idx, count(*) AS n, ({HIGH}) AS high, ({Q.LOW}) AS low FROM p GROUP BY idx)"
_FOOT = f"""UNION ALL SELECT 'price_sum{{shop="all"}} ' || {_MIDS}::BIGINT || ' ' || {_LAST_DAY} FROM b
UNION ALL SELECT 'price_count{{shop="all"}} ' || sum(n)::BIGINT || ' ' || {_LAST_DAY} FROM b"""
_add(
    "exposition_histogram",
    lambda s, d: exposition.lines(P.shop_price(s, d), P.GROUPING_POWER).select("line"),
    f"""WITH {_PRICES}, {_ENDS}
SELECT 'price_bucket{{shop="all",le="' || high || '"}} ' || (sum(n) OVER (ORDER BY idx))::BIGINT || ' ' || {_LAST_DAY} AS line FROM b
UNION ALL SELECT 'price_bucket{{shop="all",le="+Inf"}} ' || sum(n)::BIGINT || ' ' || {_LAST_DAY} FROM b {_FOOT} UNION ALL SELECT '# TYPE price histogram'""",
)
_add(
    "exposition_summary",
    lambda s, d: exposition.lines(P.shop_price(s, d), P.GROUPING_POWER, [0.5, 0.99]).select("line"),
    f"""WITH {_PRICES}, {_ENDS}, c AS (SELECT high, idx, sum(n) OVER (ORDER BY idx) AS upto, sum(n) OVER () AS total FROM b)
SELECT 'price{{shop="all",quantile="' || q || '"}} ' || min(high) || ' ' || {_LAST_DAY} AS line FROM c, (VALUES ('0.5', 0.5::DOUBLE), ('0.99', 0.99::DOUBLE)) AS x(q, share) WHERE upto >= greatest(1, ceil(share * total)) GROUP BY q
{_FOOT} UNION ALL SELECT '# TYPE price summary'""",
)

# ---- composition ----

_DAYS = "(SELECT (min(epoch_us(o_orderdate)) * 1000 + max(epoch_us(o_orderdate)) * 1000) // 2 FROM orders)"


def _per_tick(counts: DataFrame, *labels: str) -> DataFrame:
    return flat(counts, *labels)


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = P.shop_price(s, d)
    first, last = P.span(s, d, "orders", "o_orderdate")
    return rows.where(F.col("t") < (first + last) // 2), rows.where(F.col("t") >= (first + last) // 2)


_add(
    "source_histogram_merge",
    lambda s, d: _per_tick(histogram.count(compose.side_by_side(*_halves(s, d)), *P.span(s, d, "orders", "o_orderdate"))),
    f"WITH {_PRICES} SELECT t, {near_sql('count(*)::DOUBLE')} FROM p WHERE t > (SELECT min(t) FROM p) GROUP BY t",
)
_add(
    "source_layout_runs",
    lambda s, d: _per_tick(
        histogram.total(
            compose.one_run(compose.spliced(P.shop_price(s, d, half=0), P.shop_price(s, d, 3, half=1)), 0), P.GROUPING_POWER, *P.span(s, d, "orders", "o_orderdate")
        ).unionByName(histogram.total(compose.one_run(compose.spliced(P.shop_price(s, d, half=0), P.shop_price(s, d, 3, half=1)), 1), 3, *P.span(s, d, "orders", "o_orderdate")))
    ),
    "WITH " + ", ".join(
        f"""p{i} AS (SELECT epoch_us(o_orderdate) * 1000 AS t, {index_sql('floor(o_totalprice)::BIGINT', p)} AS idx FROM orders WHERE epoch_us(o_orderdate) * 1000 {op} {_DAYS}),
m{i} AS (SELECT t, sum((({Q.bound_sql('idx', p)[0]})::DOUBLE + ({Q.bound_sql('idx', p)[1]})::DOUBLE) / 2) AS v FROM p{i} WHERE t > (SELECT min(t) FROM p{i}) GROUP BY t)"""
        for i, (p, op) in enumerate(((P.GROUPING_POWER, "<"), (3, ">=")))
    ) + f" SELECT t, {near_sql('v')} FROM m0 UNION ALL SELECT t, {near_sql('v')} FROM m1",
)


def _mixed(s: SparkSession, d: str) -> DataFrame:
    rows, middle = P.events_total(s, d), sum(_span(s, d)) // 2
    none = {c: F.lit(None).cast("long") for c in ("w_begin", "w_end")}
    both = compose.spliced(rows.where(F.col("t") < middle), rows.where(F.col("t") >= middle).withColumns(none))
    return flat(counters.rate(both, STEP, *_span(s, d)), "event_type", band=True)


_add(
    "source_mixed_windows",
    _mixed,
    f"WITH {rate_sql(TOTAL, 'r', STEP, START, END)} SELECT k AS event_type, t, {near_sql('v')}, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM r",
)

# ---- matching and grouping of several series a key ----

_SHARD = f"SELECT event_type || '/' || (user_id % 3) AS k, {NS} AS t, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id) AS v FROM events"
_CENTS = f"""SELECT event_type || '/' || (user_id % 3) AS k, {NS} AS t,
  sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS v FROM events"""
_rated = lambda source, name: rate_sql(source, name, STEP, START, END)
_type, _part = "split_part({}.k, '/', 1)", "split_part({}.k, '/', 2)"


def _rate(source: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: counters.rate(source(s, d), STEP, *_span(s, d))


for _op, _sql in (("sum", "sum(v)"), ("max", "max(v)"), ("count", "count(v)::DOUBLE")):
    _add(
        f"agg_{_op}_rate_of_shards",
        lambda s, d, op=_op: flat(aggregate.aggregate(_rate(P.events_by_shard)(s, d), op, by=["event_type"]), "event_type"),
        f"WITH {_rated(_SHARD, 'r')} SELECT {_type.format('r')} AS event_type, t, {near_sql(_sql)} FROM r GROUP BY ALL",
    )
_add(
    "bin_on_first_of_many",
    lambda s, d: flat(binary.series(_rate(P.events_by_shard)(s, d), _rate(P.events_total)(s, d), "/", on=["event_type"]), "event_type", "shard"),
    f"""WITH {_rated(_SHARD, 'a')}, {_rated(TOTAL, 'b')}, f AS (SELECT {_type.format('a')} AS e, min(k) AS k FROM a GROUP BY e)
SELECT f.e AS event_type, {_part.format('a')} AS shard, a.t, {near_sql('a.v / b.v')} FROM f JOIN a ON a.k = f.k JOIN b ON b.k = f.e AND b.t = a.t WHERE b.v <> 0""",
)
_add(
    "bin_ignoring_first_and_last",
    lambda s, d: flat(binary.series(_rate(P.revenue_by_shard)(s, d), _rate(P.events_by_shard)(s, d), "-", ignoring=["shard"]), "event_type", "shard"),
    f"""WITH {_rated(_CENTS, 'a')}, {_rated(_SHARD, 'b')}, f AS (SELECT {_type.format('a')} AS e, min(k) AS k FROM a GROUP BY e), l AS (SELECT {_type.format('b')} AS e, max(k) AS k FROM b GROUP BY e)
SELECT f.e AS event_type, {_part.format('a')} AS shard, a.t, {near_sql('a.v - b.v')} FROM f JOIN l ON l.e = f.e JOIN a ON a.k = f.k JOIN b ON b.k = l.k AND b.t = a.t""",
)
_add(
    "bin_div_some_zero_drop",
    lambda s, d: flat(binary.series(*[gauges.last(x(s, d), STEP, *_span(s, d), SECOND) for x in (P.type_value, P.third_value)], "/"), "event_type"),
    f"WITH {last_sql(TYPE_VALUE, 'g', STEP, START, END)} SELECT k AS event_type, t, {near_sql('v / (v::BIGINT % 3)')} FROM g WHERE v::BIGINT % 3 <> 0",
)
_add(
    "bin_numbers",
    lambda s, d: s.createDataFrame([(op, float(binary.numbers(op, 7, 2))) for op in "+-*/"], "op string, v double"),
    "SELECT * FROM (VALUES ('+', 9.0::DOUBLE), ('-', 5.0::DOUBLE), ('*', 14.0::DOUBLE), ('/', 3.5::DOUBLE)) AS x(op, v)",
)
_BOTH_LABELS = f"""o AS (SELECT o_orderpriority AS k, o_orderstatus AS st, epoch_us(o_orderdate) * 1000 AS t, {index_sql('floor(o_totalprice)::BIGINT')} AS idx FROM orders),
f AS (SELECT k, st, min(t) AS t0 FROM o GROUP BY ALL), e AS (SELECT o.* FROM o JOIN f ON o.k = f.k AND o.st = f.st AND o.t > f.t0)"""
_add(
    "hist_sum_without_of_two",
    lambda s, d: flat(histogram.total(P.status_price(s, d), P.GROUPING_POWER, *P.span(s, d, "orders", "o_orderdate"), without=["o_orderstatus"]), "o_orderpriority"),
    f"WITH {_BOTH_LABELS} SELECT k AS o_orderpriority, t, {near_sql(f'sum({MID})')} FROM e GROUP BY k, t",
)

# ---- bands ----


def _band_sql(n: str, begin: str, width: str, v: str) -> str:
    """CTEs up to ``n``(k, t, v, lo, hi and the edges): a counter's rate; begin and width in ns, begin from the sample's time."""
    return f"""{n}_s AS (SELECT k, t, v::DOUBLE AS cum, wb::DOUBLE AS wb, (wb + ww)::DOUBLE AS we FROM (SELECT event_type AS k, {NS} AS t, {begin} AS wb, {width} AS ww, {v} AS v FROM events) WHERE t BETWEEN {START - STEP} AND {END}),
{n}_g AS (SELECT k, tk FROM (SELECT DISTINCT k FROM {n}_s), {Q.ticks(START - STEP, END)}),
{n}_a AS (SELECT g.k, g.tk, s.t AS t1, s.cum AS c1, s.wb AS b1, s.we AS e1 FROM {n}_g g ASOF JOIN {n}_s s ON g.k = s.k AND g.tk >= s.t),
{n}_b AS (SELECT a.*, s.t AS t2, s.cum AS c2, s.wb AS b2, s.we AS e2 FROM {n}_a a ASOF JOIN {n}_s s ON a.k = s.k AND a.tk <= s.t),
{n}_q AS (SELECT *, CASE WHEN t2 = tk THEN 1 ELSE (tk - t1)::DOUBLE / (t2 - t1) END AS f FROM {n}_b),
{n}_v AS (SELECT k, tk, c1 + f * (c2 - c1) AS c, b1 + f * (b2 - b1) AS wb, e1 + f * (e2 - e1) AS we FROM {n}_q),
{n}_r AS (SELECT x.k, x.tk AS t, x.c - y.c AS inc, (x.c - y.c) / {STEP / SECOND} AS v, (x.we - y.wb + {STEP}) / 1e9 AS longest, (x.wb - y.we + {STEP}) / 1e9 AS shortest,
    y.wb + (x.tk - {STEP}) AS lb, y.we + (x.tk - {STEP}) AS le, x.wb + x.tk AS rb, x.we + x.tk AS re
  FROM {n}_v x JOIN {n}_v y ON x.k = y.k AND y.tk = x.tk - {STEP} WHERE x.tk BETWEEN {START} AND {END}),
{n} AS (SELECT k, t, v, least(inc / longest, v) AS lo, greatest(inc / shortest, v) AS hi, lb, le, rb, re FROM {n}_r)"""


def _wide_sql(side: str) -> str:
    own_long, own_short = f"({side}.re - {side}.lb)", f"({side}.rb - {side}.le)"
    lo = f"least({side}.lo, {side}.lo * ({own_long} / (greatest(a.re, b.re) - least(a.lb, b.lb))), {side}.v) AS {side}lo"
    hi = f"greatest({side}.hi, {side}.hi * ({own_short} / (least(a.rb, b.rb) - greatest(a.le, b.le))), {side}.v) AS {side}hi"
    return f"{lo}, {hi}"


_add(
    "bin_band_cross_read",
    lambda s, d: flat(binary.series(_rate(P.slow_total)(s, d), _rate(P.events_total)(s, d), "-"), "event_type", band=True),
    f"""WITH {_band_sql('a', '-(event_id % 4 * 600000000000)', '(event_id % 6 + 2) * 600000000000', f'3 * row_number() {BY_TYPE}')},
{_band_sql('b', '-(event_id % 7 * 1000000)', '(event_id % 5 + 1) * 1000000', f'row_number() {BY_TYPE}')},
w AS (SELECT a.k, a.t, a.v - b.v AS v, {_wide_sql('a')}, {_wide_sql('b')} FROM a JOIN b ON a.k = b.k AND a.t = b.t)
SELECT k AS event_type, t, {near_sql('v')}, {near_sql('alo - bhi', 'lo')}, {near_sql('ahi - blo', 'hi')} FROM w""",
)


def _some_banded(s: SparkSession, d: str) -> DataFrame:
    points = P.daily_orders(s, d)
    missing = (F.col("labels")["o_orderpriority"] < "3") & (F.col("v") % 4 == 0)
    return points.withColumns({c: F.when(~missing, F.col(c)) for c in ("lo", "hi")})


_add(
    "band_all_or_none",
    lambda s, d: flat(U.all_or_none(_some_banded(s, d)), "o_orderpriority", band=True),
    """WITH p AS (SELECT o_orderpriority, epoch_us(o_orderdate) * 1000 AS t, count(*)::DOUBLE AS v FROM orders GROUP BY ALL),
q AS (SELECT *, bool_and(NOT (o_orderpriority < '3' AND v % 4 = 0)) OVER (PARTITION BY o_orderpriority) AS ok FROM p)
SELECT o_orderpriority, t, v, CASE WHEN ok THEN v - 1 END AS lo, CASE WHEN ok THEN v + 1 END AS hi FROM q""",
)

# ---- display ----

_RUNGS = " ".join(f"WHEN raw <= {w} THEN {w}" for w in display.WIDTHS)


def _fine(s: SparkSession, d: str) -> DataFrame:
    rows = P.type_value(s, d)
    points = rows.select("series", "labels", "t", F.col("v").cast("double").alias("v"))
    near = lambda c: (F.round(F.col(c), 6) + 0.0).alias(c)
    box = display.boxplot(points, 150, (0.2, 0.7), MINUTE)
    return box.select(F.col("labels")["event_type"].alias("event_type"), "t", *[near(c) for c in ("min", "lo", "median", "hi", "max")], "n", "decimated", "raw_points", "reducer", "band_low", "band_high", "native_interval")


_add(
    "display_boxplot_hours",
    _fine,
    f"""WITH p AS (SELECT k, t, v::DOUBLE AS v FROM ({TYPE_VALUE})),
w AS (SELECT k, count(*) AS raw_points, count(*) > 150 AS decimated, (max(t) - min(t)) / 1e9 / 150 AS raw FROM p GROUP BY k),
x AS (SELECT *, CASE WHEN NOT decimated THEN 1 ELSE (CASE {_RUNGS} ELSE ceil(raw / 86400) * 86400 END)::BIGINT * 1000000000 END AS w FROM w),
b AS (SELECT p.k, p.t - p.t % x.w AS t, p.v, raw_points, decimated FROM p JOIN x ON p.k = x.k)
SELECT k AS event_type, t, min(v) AS min, round(quantile_cont(v, 0.2), 6) + 0.0 AS lo, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, round(quantile_cont(v, 0.7), 6) + 0.0 AS hi, max(v) AS max,
  count(*) AS n, decimated, raw_points, 'boxplot' AS reducer, 0.2::DOUBLE AS band_low, 0.7::DOUBLE AS band_high, 60.0::DOUBLE AS native_interval FROM b GROUP BY k, t, decimated, raw_points""",
)

# ---- streams ----


def _stream(s: SparkSession, d: str, table: str) -> DataFrame:
    shape = s.read.parquet(f"{d}/{table}.parquet").schema
    return s.readStream.schema(shape).parquet(f"{d}/{table}.parque[t]")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d, "events").select(F.lit("gauge").alias("kind"), F.lit("value").alias("metric"), F.col("event_type").alias("series"), P.nanos("ts").alias("raw_t"), F.round(F.col("value") * 100).cast("long").alias("v"))
    folder = new_folder(s, "ingest")
    live.append_to(live.snapped(e, MINUTE), f"{folder}/table", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/table").select("kind", "metric", F.col("series").alias("event_type"), "t", "raw_t", "v")


_add("stream_ingest_table", _ingested, f"SELECT 'gauge' AS kind, 'value' AS metric, k AS event_type, {_SNAPPED} AS t, t AS raw_t, v FROM ({TYPE_VALUE})")
_LATE = 3600


def _means(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d, "events").select(F.col("event_type").alias("series"), P.nanos("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"))
    out = live.run_through(live.windowed_mean(e, 6 * 3600, _LATE), new_folder(s, "windows"))
    start = (F.unix_micros("start") * 1000).alias("t")
    return out.select(F.col("series").alias("event_type"), start, (F.round("v", 6) + 0.0).alias("v"))


_add(
    "stream_tumbling_mean",
    _means,
    f"""WITH w AS (SELECT k, t - t % {6 * HOUR} AS w, avg(v) AS v FROM ({TYPE_VALUE}) GROUP BY ALL)
SELECT k AS event_type, w AS t, {near_sql('v')} FROM w WHERE w + {6 * HOUR} <= (SELECT max({NS}) FROM events) - {_LATE * SECOND}""",
)


def _gauge(s: SparkSession, d: str) -> DataFrame:
    e = _stream(s, d, "events").select(F.col("event_type").alias("series"), P.nanos("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return live.run_through(live.grid_last(e, STEP), new_folder(s, "gauges")).select(F.col("series").alias("event_type"), "t", "v")


_add(
    "stream_gauge_last",
    _gauge,
    f"WITH {last_sql(TYPE_VALUE, 'g', STEP, START, END)} SELECT g.k AS event_type, g.t, g.v FROM g JOIN (SELECT event_type AS k, max({NS}) AS m FROM events GROUP BY k) USING (k) WHERE g.t < m",
)


def _live_histogram(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "histograms")
    P.order_price(s, d).select("series", "t", "buckets").write.parquet(f"{folder}/in")
    rows = s.readStream.schema("series string, t long, buckets array<struct<idx:int,cnt:bigint>>").parquet(f"{folder}/in")
    return live.run_through(live.histogram_events(rows), f"{folder}/run").groupBy("t", "idx").agg(F.sum("cnt").alias("cnt"))


_add(
    "stream_histogram_events",
    _live_histogram,
    f"WITH {Q.hist_sql(Q._O_FIRST, Q._O_LAST)} SELECT t, idx::INTEGER AS idx, sum(cnt)::BIGINT AS cnt FROM e GROUP BY t, idx",
)
