"""A query for each metric operator over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.frames import SECOND
from tidegrid.functions import labels as L
from tidegrid.operators import aggregate, binary, counters, display, gauges, histogram
from tidegrid.plans import projections as P
from tidegrid.scratch import new_folder
from tidegrid.sources import compose, exposition, schema
from tidegrid.streaming import live

HOUR = 3600 * SECOND
STEP = 6 * HOUR
#: 2024-01-02 to 2024-01-29, and for orders 1996-01-01 to 1997-12-31.
START, END = 1_704_153_600 * SECOND, 1_706_486_400 * SECOND
O_START, O_END = 820_454_400 * SECOND, 883_526_400 * SECOND
DAY = 24 * HOUR
#: Queries named so read whole tables; those without it the ranges above, as their SQL does.
WHOLE = "_whole"
RANGE = 12 * HOUR


class Sql(str):
    """An SQL expression that adds up like the number that it stands for."""

    def __add__(self, other: int | str) -> Sql:
        return Sql(f"({self:s} + {other})")

    def __sub__(self, other: int | str) -> Sql:
        return Sql(f"({self:s} - {other})")

    def __mod__(self, other: int | str) -> Sql:
        return Sql(f"({self:s} % {other})")

    def __floordiv__(self, other: int | str) -> Sql:
        return Sql(f"({self:s} // {other})")


Bound = int | Sql
Span = Callable[[SparkSession, str], tuple[int, int]]


def flat(points: DataFrame, *labels: str, band: bool = False) -> DataFrame:
    """Labels as columns, t, and rounded values."""
    near = lambda c: (F.round(F.col(c), 6) + 0.0).alias(c)
    return points.select(*[F.col("labels")[x].alias(x) for x in labels], "t", near("v"), *([near("lo"), near("hi")] if band else []))


# ---- SQL that the queries share ----

NS = "epoch_us(ts) * 1000"
BY_TYPE = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"
TOTAL = f"SELECT event_type AS k, {NS} AS t, row_number() {BY_TYPE} AS v FROM events"
WRAPPED = f"SELECT event_type AS k, {NS} AS t, row_number() {BY_TYPE} % 50 AS v FROM events"
REVENUE = f"SELECT event_type AS k, {NS} AS t, sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS v FROM events"
VALUE = f"SELECT event_type || '/' || user_id AS k, event_type, user_id::VARCHAR AS user_id, {NS} AS t, round(value * 100)::BIGINT AS v FROM events"
TYPE_VALUE = f"SELECT event_type AS k, {NS} AS t, round(value * 100)::BIGINT AS v FROM events"
USER = f"SELECT 'site' AS k, {NS} AS t, user_id + 1 AS v FROM events"


def ticks(start: Bound, end: Bound, step: int = STEP) -> str:
    return f"(SELECT unnest(range({start}::BIGINT, {end + 1}::BIGINT, {step}::BIGINT)) AS tk)"


def rate_sql(source: str, name: str, step: int, start: Bound, end: Bound) -> str:
    """CTEs up to ``name``(k, t, v): the rate on a grid of the counter that ``source`` selects."""
    n = name
    return f"""{n}_s AS (SELECT k, t, v, lag(v) OVER (PARTITION BY k ORDER BY t) AS pv FROM ({source}) WHERE t BETWEEN {start - step} AND {end}),
{n}_c AS (SELECT k, t, sum(CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING)::DOUBLE AS cum FROM {n}_s),
{n}_g AS (SELECT k, tk FROM (SELECT DISTINCT k FROM {n}_c), {ticks(start - step, end, step)}),
{n}_a AS (SELECT g.k, g.tk, c.t AS t1, c.cum AS c1 FROM {n}_g g ASOF JOIN {n}_c c ON g.k = c.k AND g.tk >= c.t),
{n}_b AS (SELECT a.*, c.t AS t2, c.cum AS c2 FROM {n}_a a ASOF JOIN {n}_c c ON a.k = c.k AND a.tk <= c.t),
{n}_v AS (SELECT k, tk, CASE WHEN t2 = tk THEN c2 ELSE c1 + (tk - t1)::DOUBLE / (t2 - t1) * (c2 - c1) END AS cv FROM {n}_b),
{n} AS (SELECT x.k, x.tk AS t, (x.cv - y.cv) / {step / SECOND} AS v FROM {n}_v x JOIN {n}_v y ON x.k = y.k AND y.tk = x.tk - {step} WHERE x.tk BETWEEN {start} AND {end})"""


def last_sql(source: str, name: str, step: int, start: Bound, end: Bound) -> str:
    """CTEs up to ``name``(k, t, v): the last value, not older than the step, on a grid."""
    return f"""{name}_s AS (SELECT * FROM ({source}) WHERE t BETWEEN {start - step} AND {end}),
{name} AS (SELECT g.k, g.tk AS t, s.v::DOUBLE AS v FROM (SELECT k, tk FROM (SELECT DISTINCT k FROM {name}_s), {ticks(start, end, step)}) g ASOF JOIN {name}_s s ON g.k = s.k AND g.tk >= s.t WHERE g.tk - s.t <= {step})"""


def near_sql(expression: str, alias: str = "v") -> str:
    return f"round({expression}, 6) + 0.0 AS {alias}"


def index_sql(v: str, p: int = P.GROUPING_POWER) -> str:
    cut, e = 1 << (p + 1), f"(length(bin({v})) - 1)"
    return f"CASE WHEN {v} < {cut} THEN {v} ELSE {cut} + ({e} - {p + 1}) * {1 << p} + (({v} - (1::BIGINT << {e})) >> ({e} - {p})) END"


def bound_sql(i: str, p: int = P.GROUPING_POWER) -> tuple[str, str]:
    cut = 1 << (p + 1)
    e, tk = f"({p + 1} + ({i} - {cut}) // {1 << p})::INTEGER", f"(({i} - {cut}) % {1 << p})"
    low = f"(CASE WHEN {i} < {cut} THEN {i} ELSE (1::BIGINT << {e}) + {tk} * (1::BIGINT << ({e} - {p})) END)"
    high = f"(CASE WHEN {i} < {cut} THEN {i} ELSE (1::BIGINT << {e}) + ({tk} + 1) * (1::BIGINT << ({e} - {p})) - 1 END)"
    return low, high


def hist_sql(start: Bound, end: Bound, where: str = "TRUE") -> str:
    """CTEs up to e(k, t, idx, cnt): events by bucket at each tick but a series' first."""
    return f"""o AS (SELECT o_orderpriority AS k, epoch_us(o_orderdate) * 1000 AS t, floor(o_totalprice)::BIGINT AS val FROM orders WHERE {where}),
r AS (SELECT k, t, {index_sql('val')} AS idx FROM o WHERE t BETWEEN {start} AND {end}),
f AS (SELECT k, min(t) AS t0 FROM r GROUP BY k),
e AS (SELECT r.k, r.t, r.idx, count(*) AS cnt FROM r JOIN f ON r.k = f.k WHERE r.t > f.t0 GROUP BY ALL)"""


LOW, HIGH = bound_sql("idx")
MID = f"(({LOW})::DOUBLE + ({HIGH})::DOUBLE) / 2"


# ---- queries ----

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _define(suffix: str, START: Bound, END: Bound, O_START: Bound, O_END: Bound, span: Span, o_span: Span) -> None:  # noqa: N803
    """The queries on a grid or over a range, with ``suffix`` to their names.

    The bounds of time are given twice: as SQL has them, and as functions of a session and a folder.
    """

    def add(name: str, query: Query, sql: str | None = None) -> None:
        _add(name + suffix, query, sql)

    rated = lambda source, name: rate_sql(source, name, STEP, START, END)
    lasted = lambda source, name: last_sql(source, name, STEP, START, END)

    def _rate(source: Callable = P.events_total) -> Query:
        return lambda spark, d: counters.rate(source(spark, d), STEP, *span(spark, d))

    def _last(source: Callable = P.type_value) -> Query:
        return lambda spark, d: gauges.last(source(spark, d), STEP, *span(spark, d), SECOND)

    BASIC = f"WITH {rated(TOTAL, 'r')} SELECT k AS event_type, t, {near_sql('v')} FROM r"
    add("counter_rate_grid", lambda s, d: flat(_rate()(s, d), "event_type"), BASIC)
    add("counter_irate_grid", lambda s, d: flat(_rate()(s, d), "event_type"), BASIC)
    add("counter_rate_resets", lambda s, d: flat(_rate(P.wrapped_total)(s, d), "event_type"), f"WITH {rated(WRAPPED, 'r')} SELECT k AS event_type, t, {near_sql('v')} FROM r")
    add("counter_rate_revenue", lambda s, d: flat(_rate(P.revenue_total)(s, d), "event_type"), f"WITH {rated(REVENUE, 'r')} SELECT k AS event_type, t, {near_sql('v')} FROM r")
    _PAIRS = "p AS (SELECT k, t, CASE WHEN v >= pv THEN v - pv ELSE v END / ((t - pt) / 1e9) AS v FROM (SELECT k, t, v, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM ({}) WHERE t BETWEEN {} AND {} WINDOW w AS (PARTITION BY k ORDER BY t)) WHERE t > pt)"
    add(
        "counter_rate_raw",
        lambda s, d: flat(counters.raw_rate(P.wrapped_total(s, d), *span(s, d), RANGE), "event_type"),
        f"WITH {_PAIRS.format(WRAPPED, START - RANGE, END)} SELECT k AS event_type, t, {near_sql('v')} FROM p WHERE t >= {START}",
    )
    _SLOPE = "SELECT k AS event_type, tk AS t, " + near_sql("coalesce(regr_slope(v::DOUBLE, (t - tk) / 1e9), 0)").replace("6)", "12)") + f" FROM {{}} JOIN {ticks(START, END)} ON t BETWEEN tk - {2 * STEP} AND tk + {STEP} GROUP BY ALL HAVING count(*) >= 2"
    _fine = lambda df: df.select(F.col("labels")["event_type"].alias("event_type"), "t", (F.round("v", 12) + 0.0).alias("v"))
    add("counter_deriv2", lambda s, d: _fine(counters.second_derivative(P.events_total(s, d), STEP, *span(s, d))), f"WITH {_PAIRS.format(TOTAL, START - 2 * STEP, END)} {_SLOPE.format('p')}")

    _BAND = f"""WITH x AS (SELECT event_type AS k, {NS} AS t, event_id % 7 AS a, event_id % 5 + 1 AS b, row_number() {BY_TYPE} AS v FROM events),
s AS (SELECT k, t, v::DOUBLE AS cum, (-a * 1000000)::DOUBLE AS wb, ((b - a) * 1000000)::DOUBLE AS we FROM x WHERE t BETWEEN {START - STEP} AND {END}),
g AS (SELECT k, tk FROM (SELECT DISTINCT k FROM s), {ticks(START - STEP, END)}),
a AS (SELECT g.k, g.tk, s.t AS t1, s.cum AS c1, s.wb AS b1, s.we AS e1 FROM g ASOF JOIN s ON g.k = s.k AND g.tk >= s.t),
b AS (SELECT a.*, s.t AS t2, s.cum AS c2, s.wb AS b2, s.we AS e2 FROM a ASOF JOIN s ON a.k = s.k AND a.tk <= s.t),
q AS (SELECT k, tk, CASE WHEN t2 = tk THEN 1 ELSE (tk - t1)::DOUBLE / (t2 - t1) END AS f, c1, c2, b1, b2, e1, e2 FROM b),
v AS (SELECT k, tk, c1 + f * (c2 - c1) AS c, b1 + f * (b2 - b1) AS wb, e1 + f * (e2 - e1) AS we FROM q),
r AS (SELECT x.k, x.tk AS t, (x.c - y.c) AS inc, (x.c - y.c) / {STEP / SECOND} AS v, (x.we - y.wb + {STEP}) / 1e9 AS longest, (x.wb - y.we + {STEP}) / 1e9 AS shortest FROM v x JOIN v y ON x.k = y.k AND y.tk = x.tk - {STEP} WHERE x.tk BETWEEN {START} AND {END}),
p AS (SELECT k, t, v, least(inc / longest, v) AS lo, greatest(inc / shortest, v) AS hi FROM r)"""
    add("counter_rate_band", lambda s, d: flat(_rate()(s, d), "event_type", band=True), f"{_BAND} SELECT k AS event_type, t, {near_sql('v')}, {near_sql('lo', 'lo')}, {near_sql('hi', 'hi')} FROM p")
    add("rate_band_scalar_mul", lambda s, d: flat(binary.scalar(_rate()(s, d), "*", -60), "event_type", band=True), f"{_BAND} SELECT k AS event_type, t, {near_sql('v * -60')}, {near_sql('hi * -60', 'lo')}, {near_sql('lo * -60', 'hi')} FROM p")
    for _op, _n in (("sum", "1"), ("avg", "count(*)")):
        add(
            f"agg_{_op}_band",
            lambda s, d, op=_op: flat(aggregate.aggregate(_rate()(s, d), op), band=True),
            f"{_BAND} SELECT t, {near_sql(f'sum(v) / {_n}')}, {near_sql(f'sum(lo) / {_n}', 'lo')}, {near_sql(f'sum(hi) / {_n}', 'hi')} FROM p GROUP BY t",
        )
    add("bin_band_same_read", lambda s, d: flat(binary.series(_rate()(s, d), binary.scalar(_rate()(s, d), "*", 2), "+"), "event_type", band=True), f"{_BAND} SELECT k AS event_type, t, {near_sql('v * 3')}, {near_sql('lo * 3', 'lo')}, {near_sql('hi * 3', 'hi')} FROM p")

    # Gauges
    add("gauge_step_grid", lambda s, d: flat(_last()(s, d), "event_type"), f"WITH {lasted(TYPE_VALUE, 'g')} SELECT k AS event_type, t, {near_sql('v')} FROM g")
    add("gauge_step_grid_users", lambda s, d: flat(_last(P.event_value)(s, d), "event_type", "user_id"), f"WITH {lasted(VALUE, 'g')} SELECT split_part(k, '/', 1) AS event_type, split_part(k, '/', 2) AS user_id, t, {near_sql('v')} FROM g")
    add("gauge_raw", lambda s, d: flat(gauges.raw(P.type_value(s, d), STEP, *span(s, d), SECOND), "event_type"), f"SELECT k AS event_type, t, {near_sql('v::DOUBLE')} FROM ({TYPE_VALUE}) WHERE t BETWEEN {START - STEP} AND {END}")
    _WITHIN = f"FROM (SELECT * FROM ({{}}) WHERE t BETWEEN {START - RANGE} AND {END}) JOIN {ticks(START, END)} ON t BETWEEN tk - {RANGE} AND tk"
    add("gauge_avg_over_time", lambda s, d: flat(gauges.avg_over_time(P.event_value(s, d), RANGE, STEP, *span(s, d)), "event_type", "user_id"), f"SELECT event_type, user_id, tk AS t, {near_sql('avg(v)')} {_WITHIN.format(VALUE)} GROUP BY ALL")
    add(
        "gauge_idelta",
        lambda s, d: flat(gauges.idelta(P.type_value(s, d), RANGE, STEP, *span(s, d)), "event_type"),
        f"SELECT k AS event_type, tk AS t, {near_sql('(max_by(v, t, 2)[1] - max_by(v, t, 2)[2])::DOUBLE')} {_WITHIN.format(TYPE_VALUE)} GROUP BY ALL HAVING count(*) >= 2",
    )
    add("gauge_deriv", lambda s, d: _fine(gauges.deriv(P.type_value(s, d), STEP, *span(s, d))), f"WITH s AS (SELECT * FROM ({TYPE_VALUE}) WHERE t BETWEEN {START - 2 * STEP} AND {END}) {_SLOPE.format('s')}")

    # Aggregates over many series
    _USERS = f"WITH {lasted(VALUE, 'g')}, p AS (SELECT split_part(k, '/', 1) AS event_type, split_part(k, '/', 2) AS user_id, t, v FROM g)"
    for _op, _sql in (("sum", "sum(v)"), ("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "count(v)::DOUBLE")):
        add(
            f"agg_{_op}_by" if _op == "sum" else f"agg_{_op}",
            lambda s, d, op=_op: flat(aggregate.aggregate(_last(P.event_value)(s, d), op, by=["event_type"]), "event_type"),
            f"{_USERS} SELECT event_type, t, {near_sql(_sql)} FROM p GROUP BY ALL",
        )
    add("agg_sum_without", lambda s, d: flat(aggregate.aggregate(_last(P.event_value)(s, d), "sum", without=["event_type"]), "user_id"), f"{_USERS} SELECT user_id, t, {near_sql('sum(v)')} FROM p GROUP BY ALL")
    add("agg_sum_all", lambda s, d: flat(aggregate.aggregate(_last(P.event_value)(s, d), "sum")), f"{_USERS} SELECT t, {near_sql('sum(v)')} FROM p GROUP BY ALL")
    add("agg_sum_rate", lambda s, d: flat(aggregate.aggregate(_rate()(s, d), "sum", by=["event_type"]), "event_type"), BASIC)

    # Binary operators
    for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("div", "/")):
        add(f"bin_scalar_{_name}", lambda s, d, op=_op: flat(binary.scalar(_last()(s, d), op, 7), "event_type"), f"WITH {lasted(TYPE_VALUE, 'g')} SELECT k AS event_type, t, {near_sql(f'v {_op} 7')} FROM g")
    add("bin_scalar_first_div", lambda s, d: flat(binary.scalar(_last()(s, d), "/", 1000, number_first=True), "event_type"), f"WITH {lasted(TYPE_VALUE, 'g')} SELECT k AS event_type, t, {near_sql('1000 / v')} FROM g WHERE v <> 0")
    _BOTH = f"WITH {rated(REVENUE, 'a')}, {rated(TOTAL, 'b')}"
    _ratio = lambda **how: lambda s, d: flat(binary.series(_rate(P.revenue_total)(s, d), _rate()(s, d), "/", **how), "event_type")
    _RATIO = f"{_BOTH} SELECT a.k AS event_type, a.t, {near_sql('a.v / b.v')} FROM a JOIN b ON a.k = b.k AND a.t = b.t WHERE b.v <> 0"
    add("bin_series_div_default", _ratio(), _RATIO)
    add("bin_on", _ratio(on=["event_type"]), _RATIO)
    add("bin_ignoring", _ratio(ignoring=["nothing"]), _RATIO)
    add("bin_series_sub", lambda s, d: flat(binary.series(_rate(P.revenue_total)(s, d), _rate()(s, d), "-"), "event_type"), f"{_BOTH} SELECT a.k AS event_type, a.t, {near_sql('a.v - b.v')} FROM a JOIN b ON a.k = b.k AND a.t = b.t")
    add(
        "bin_single_right_broadcast",
        lambda s, d: flat(binary.series(_rate()(s, d), _last(P.last_user)(s, d), "/"), "event_type"),
        f"WITH {rated(TOTAL, 'a')}, {lasted(USER, 'b')} SELECT a.k AS event_type, a.t, {near_sql('a.v / b.v')} FROM a JOIN b ON a.t = b.t",
    )
    add(
        "bin_div_zero_drop",
        lambda s, d: flat(binary.series(_last()(s, d), binary.scalar(_last()(s, d), "*", 0), "/"), "event_type"),
        f"WITH {lasted(TYPE_VALUE, 'g')} SELECT k AS event_type, t, v FROM g WHERE v < 0",
    )

    # Labels
    _PICK = f"SELECT k AS event_type, t, {near_sql('v::DOUBLE')} FROM ({TYPE_VALUE}) WHERE t BETWEEN {START - STEP} AND {END} AND "
    for _name, _m, _where in (
        ("eq", ("event_type", "=", "click"), "k = 'click'"),
        ("neq", ("event_type", "!=", "click"), "k <> 'click'"),
        ("alternation", ("event_type", "=~", "(click|purchase)"), "k IN ('click', 'purchase')"),
        ("not_alternation", ("event_type", "!~", "click|purchase"), "k NOT IN ('click', 'purchase')"),
        ("absent", ("nowhere", "!=", "x"), "TRUE"),
    ):
        add(
            f"label_{_name}",
            lambda s, d, m=_m: flat(gauges.raw(P.type_value(s, d).where(L.matches(F.col("labels"), [m])), STEP, *span(s, d), SECOND), "event_type"),
            _PICK + _where,
        )

    # Histograms
    _H = f"WITH {hist_sql(O_START, O_END)}"

    def _quantile_sql(qs: list[str], scale: str = "") -> str:
        values = ", ".join(f"('{q}', {q}::DOUBLE)" for q in qs)
        return f"""{_H}, m AS (SELECT t, idx, sum(cnt)::BIGINT AS cnt FROM e GROUP BY ALL),
c AS (SELECT t, idx, sum(cnt) OVER (PARTITION BY t ORDER BY idx) AS upto, sum(cnt) OVER (PARTITION BY t) AS n FROM m),
q AS (SELECT * FROM (VALUES {values}) AS x(quantile, share)),
h AS (SELECT quantile, t, min(idx) AS idx FROM c, q WHERE upto >= greatest(1, ceil(share * n)) GROUP BY ALL)
SELECT quantile, t, {near_sql(f'({HIGH})::DOUBLE{scale}')}, {near_sql(f'({LOW})::DOUBLE{scale}', 'lo')}, {near_sql(f'({HIGH})::DOUBLE{scale}', 'hi')} FROM h"""

    _quant = lambda *qs, **how: lambda s, d: histogram.quantiles(P.order_price(s, d), list(qs), P.GROUPING_POWER, *o_span(s, d), **how)
    add("hist_quantile_p99", lambda s, d: flat(_quant(0.99)(s, d), "quantile", band=True), _quantile_sql(["0.99"]))
    add("hist_quantiles_multi", lambda s, d: flat(_quant(0.0, 0.5, 0.9, 1.0)(s, d), "quantile", band=True), _quantile_sql(["0", "0.5", "0.9", "1"]))
    add("hist_quantile_scaled", lambda s, d: flat(binary.scalar(_quant(0.5)(s, d), "/", 1000), "quantile", band=True), _quantile_sql(["0.5"], " / 1000"))
    # Ends of strides, each found from the one before; events show at the first end at or behind them.
    _RANGED = f"(SELECT epoch_us(o_orderdate) * 1000 AS t FROM orders WHERE epoch_us(o_orderdate) * 1000 BETWEEN {O_START} AND {O_END})"
    _STRIDES = f"""WITH RECURSIVE st AS (SELECT min(t) AS b FROM {_RANGED}
UNION ALL SELECT (SELECT min(t) FROM {_RANGED} WHERE t >= st.b + {30 * DAY}) FROM st WHERE EXISTS (SELECT 1 FROM {_RANGED} WHERE t >= st.b + {30 * DAY})),
bounds AS (SELECT b FROM st WHERE b > (SELECT min(b) FROM st) UNION SELECT max(t) FROM {_RANGED}),
{hist_sql(O_START, O_END)},
z AS (SELECT e.k, bounds.b AS t, e.idx, sum(e.cnt)::BIGINT AS cnt FROM e ASOF JOIN bounds ON bounds.b >= e.t GROUP BY ALL)"""
    add(
        "hist_quantiles_stride",
        lambda s, d: flat(_quant(0.5, 0.99, stride=30 * DAY)(s, d), "quantile", band=True),
        _quantile_sql(["0.5", "0.99"]).replace(_H, _STRIDES).replace("FROM e GROUP BY ALL),\nc AS", "FROM z GROUP BY ALL),\nc AS"),
    )

    def _hist_values(value: str, by: str = "") -> str:
        key = f"k AS {by}, " if by else ""
        return f"{_H} SELECT {key}t, {near_sql(value)} FROM e GROUP BY {'k, ' if by else ''}t"

    _p = P.GROUPING_POWER
    _MEAN, _SUM, _COUNT = f"sum(cnt * {MID}) / sum(cnt)", f"sum(cnt * {MID})", "sum(cnt)::DOUBLE"
    add("hist_mean", lambda s, d: flat(histogram.mean(P.order_price(s, d), _p, *o_span(s, d))), _hist_values(_MEAN))
    add("hist_mean_by", lambda s, d: flat(histogram.mean(P.order_price(s, d), _p, *o_span(s, d), by=["o_orderpriority"]), "o_orderpriority"), _hist_values(_MEAN, "o_orderpriority"))
    add("hist_sum", lambda s, d: flat(histogram.total(P.order_price(s, d), _p, *o_span(s, d))), _hist_values(_SUM))
    add("hist_sum_without", lambda s, d: flat(histogram.total(P.order_price(s, d), _p, *o_span(s, d), without=["o_orderpriority"])), _hist_values(_SUM))
    add("hist_count", lambda s, d: flat(histogram.count(P.order_price(s, d), *o_span(s, d))), _hist_values(_COUNT))
    add("hist_count_stride", lambda s, d: flat(histogram.count(P.order_price(s, d), *o_span(s, d), stride=30 * DAY)), f"{_STRIDES} SELECT t, {near_sql('sum(cnt)::DOUBLE')} FROM z GROUP BY t")

    def _irated(by: str = "") -> str:
        key = "k" if by else "1"
        return f"""{_H}, n AS (SELECT {key} AS g, t, sum(cnt)::DOUBLE AS n FROM e GROUP BY ALL),
p AS (SELECT g, t, n, lag(t) OVER (PARTITION BY g ORDER BY t) AS pt FROM n)
SELECT {'g AS ' + by + ', ' if by else ''}t, {near_sql('n / ((t - pt) / 1e9)').replace('6)', '12)')} FROM p WHERE pt IS NOT NULL"""

    _tiny = lambda df, *ls: df.select(*[F.col("labels")[x].alias(x) for x in ls], "t", (F.round("v", 12) + 0.0).alias("v"))
    add("hist_irate", lambda s, d: _tiny(histogram.irate(P.order_price(s, d), *o_span(s, d))), _irated())
    add("hist_irate_by", lambda s, d: _tiny(histogram.irate(P.order_price(s, d), *o_span(s, d), by=["o_orderpriority"]), "o_orderpriority"), _irated("o_orderpriority"))
    add(
        "hist_heatmap",
        lambda s, d: histogram.heatmap(P.order_price(s, d), _p, *o_span(s, d)),
        f"{_H} SELECT t, idx::INTEGER AS idx, ({HIGH})::BIGINT AS bucket_end, sum(cnt)::BIGINT AS cnt FROM e GROUP BY t, idx",
    )

    # Composition
    add("instant_query", lambda s, d: flat(schema.latest(_rate()(s, d)), "event_type"), f"WITH {rated(TOTAL, 'r')} SELECT k AS event_type, max(t) AS t, {near_sql('max_by(v, t)')} FROM r GROUP BY k")
    _HALF = (START + END) // 2

    def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        rows, half = P.events_total(s, d), sum(span(s, d)) // 2
        return rows.where(F.col("t") < half), rows.where(F.col("t") >= half)

    def _dup(s: SparkSession, d: str) -> DataFrame:
        both = compose.side_by_side(*_halves(s, d))
        out = counters.rate(both, STEP, *span(s, d))
        return out.select(F.substring_index("series", "#", -1).alias("source"), F.col("labels")["event_type"].alias("event_type"), "t", (F.round("v", 6) + 0.0).alias("v"))

    _PART = f"SELECT k || (CASE WHEN t < {_HALF} THEN '#000000' ELSE '#000001' END) AS k, t, v FROM ({TOTAL})"
    add("source_multi_dup", _dup, f"WITH {rated(_PART, 'r')} SELECT split_part(k, '#', 2) AS source, split_part(k, '#', 1) AS event_type, t, {near_sql('v')} FROM r")
    add("source_segmented_splice", lambda s, d: flat(counters.rate(compose.spliced(*_halves(s, d)), STEP, *span(s, d)), "event_type"), BASIC)
    add(
        "source_union_disjoint",
        lambda s, d: flat(counters.rate(schema.select(compose.disjoint(P.events_total(s, d), P.event_value(s, d)), "counter", "events_total"), STEP, *span(s, d)), "event_type"),
        BASIC,
    )


_define("", START, END, O_START, O_END, lambda s, d: (START, END), lambda s, d: (O_START, O_END))
#: The same over whole tables: from the table's first time to its last, events from the tick before to the tick after.
_FIRST, _LAST = (Sql(f"(SELECT {m}({NS}) FROM events)") for m in ("min", "max"))
_O_FIRST, _O_LAST = (Sql(f"(SELECT {m}(epoch_us(o_orderdate)) * 1000 FROM orders)") for m in ("min", "max"))
_define(
    WHOLE, _FIRST - _FIRST % STEP, _LAST - _LAST % STEP + STEP, _O_FIRST, _O_LAST,
    lambda s, d: P.grid_span(s, d, "events", "ts", STEP), lambda s, d: P.span(s, d, "orders", "o_orderdate"),
)


# Display
_BOX = """WITH p AS (SELECT o_orderpriority AS k, epoch_us(o_orderdate) * 1000 AS t, count(*)::DOUBLE AS v FROM orders GROUP BY ALL),
w AS (SELECT k, (ceil((max(t) - min(t)) / 1e9 / 100 / 86400) * 86400)::BIGINT * 1000000000 AS w FROM p GROUP BY k),
b AS (SELECT p.k, p.t - p.t % w.w AS t, p.v FROM p JOIN w ON p.k = w.k)
SELECT k AS o_orderpriority, t, min(v) AS min, {} AS lo, round(quantile_cont(v, 0.5), 6) + 0.0 AS median, {} AS hi, max(v) AS max{} FROM b GROUP BY ALL"""


def _boxes(s: SparkSession, d: str, band: str, unc: bool) -> DataFrame:
    near = lambda c: (F.round(F.col(c), 6) + 0.0).alias(c)
    box = display.boxplot(P.daily_orders(s, d), 100, band)
    return box.select(F.col("labels")["o_orderpriority"].alias("o_orderpriority"), "t", *[near(c) for c in ("min", "lo", "median", "hi", "max")], *([near("unc_lo"), near("unc_hi")] if unc else []))


_q = lambda q, plus="": f"round(quantile_cont(v, {q}){plus}, 6) + 0.0"
_add("display_boxplot", lambda s, d: _boxes(s, d, "iqr", False), _BOX.format(_q(0.25), _q(0.75), ""))
_add("display_boxplot_band", lambda s, d: _boxes(s, d, "wide", True), _BOX.format(_q(0.1), _q(0.9), f", {_q(0.5, ' - 1')} AS unc_lo, {_q(0.5, ' + 1')} AS unc_hi"))


# Introspection and composition
def _all(s: SparkSession, d: str) -> DataFrame:
    return P.events_total(s, d).unionByName(P.event_value(s, d)).unionByName(P.last_user(s, d))


_SETS = "s AS (SELECT DISTINCT 'counter' AS kind, 'events_total' AS metric, event_type, NULL AS user_id FROM events UNION ALL SELECT DISTINCT 'gauge', 'event_value', event_type, user_id::VARCHAR FROM events UNION ALL SELECT 'gauge', 'last_user', NULL, NULL)"
_add("catalog_names", lambda s, d: schema.names(_all(s, d)), f"WITH {_SETS} SELECT DISTINCT kind, metric FROM s")
_add("catalog_label_values", lambda s, d: schema.label_values(_all(s, d), "event_value"), f"WITH {_SETS} SELECT DISTINCT 'event_type' AS label, event_type AS value FROM s WHERE metric = 'event_value' UNION ALL SELECT DISTINCT 'user_id', user_id FROM s WHERE metric = 'event_value'")
_add("catalog_series_count", lambda s, d: schema.series_count(_all(s, d)), f"WITH {_SETS} SELECT kind, metric, count(*) AS n FROM s GROUP BY ALL")
_add("time_range", lambda s, d: schema.time_range(P.events_total(s, d)), f"SELECT min({NS}) AS first_ns, max({NS}) AS last_ns FROM events")
_add(
    "exposition_text",
    lambda s, d: exposition.lines(P.events_total(s, d).withColumn("buckets", F.lit(None).cast("array<struct<idx:int,cnt:bigint>>"))).select("metric", "line"),
    f"""WITH x AS (SELECT k, max(t) AS t, max_by(v, t) AS v FROM ({TOTAL}) GROUP BY k)
SELECT 'events_total' AS metric, 'events_total{{event_type="' || k || '"}} ' || v || ' ' || t // 1000000 AS line FROM x UNION ALL SELECT 'events_total', '# TYPE events_total counter'""",
)


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The rate at which event ids grow by type, from a stream over the table."""
    shape = s.read.parquet(f"{d}/events.parquet").schema
    # A pattern, as a stream takes a single file by no other path; it fits a folder of part files as well.
    events = s.readStream.schema(shape).parquet(f"{d}/events.parque[t]")
    samples = events.select(F.col("event_type").alias("series"), P.nanos("ts").alias("t"), F.col("event_id").alias("v"))
    return live.run_through(live.grid_rate(samples, STEP), new_folder(s, "stream")).select(F.col("series").alias("event_type"), "t", (F.round("v", 6) + 0.0).alias("v"))


_IDS = f"SELECT event_type AS k, {NS} AS t, event_id AS v FROM events"
_ALL = (1_704_067_200 * SECOND, 1_706_745_600 * SECOND)
_add("stream_rate_batch_equiv", _streamed, f"WITH {rate_sql(_IDS, 'r', STEP, *_ALL)} SELECT k AS event_type, t, {near_sql('v')} FROM r")
