"""Metric operators on small series with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.frames import SECOND
from tidegrid.functions import h2
from tidegrid.functions import labels as L
from tidegrid.operators import aggregate, binary, counters, display, gauges, histogram

S = SECOND


def samples(spark, series):
    """series: [(labels, [(seconds, value[, begin, end])])]."""
    rows = []
    for labels, points in series:
        for p in points:
            w = [int(x * S) for x in p[2:4]] if len(p) > 2 else [None, None]
            rows.append((labels, int(p[0] * S), p[1], *w))
    df = spark.createDataFrame(rows, "labels map<string,string>, t long, v long, w_begin long, w_end long")
    return df.withColumn("series", L.canonical(F.col("labels"))).withColumn("raw_t", F.col("t"))


def got(points, *labels):
    rows = points.orderBy("series", "t").collect()
    return [(*[r["labels"].get(x) for x in labels], r["t"] / S, round(r["v"], 6)) for r in rows]


def band(points):
    return [None if r["lo"] is None else (round(r["lo"], 4), round(r["hi"], 4)) for r in points.orderBy("series", "t").collect()]


def test_rate_on_a_grid(spark):
    c = samples(spark, [({}, [(1000 + i, 100 * i) for i in range(5)])])
    assert got(counters.rate(c, S, 1001 * S, 1004 * S, 3 * S)) == [(1001 + i, 100.0) for i in range(4)]
    uneven = samples(spark, [({}, [(0, 0), (1, 100), (2, 50), (3, 150)])])
    assert got(counters.rate(uneven, S, 0, 3 * S)) == [(1, 100.0), (2, 50.0), (3, 100.0)]
    reset = samples(spark, [({}, [(1000, 100), (1001, 200), (1002, 300), (1003, 50), (1004, 150)])])
    assert got(counters.rate(reset, S, 1004 * S, 1004 * S, 5 * S)) == [(1004, 100.0)]


def test_rate_between_off_grid_samples(spark):
    c = samples(spark, [({}, [(0.5, 0), (1.5, 100), (2.5, 200)])])
    assert got(counters.rate(c, S, 0, 3 * S)) == [(2, 100.0)]
    phase = samples(spark, [({}, [(i + 0.374, 100 * i) for i in range(6)])])
    assert [t for t, _ in got(counters.rate(phase, S, 0, 6 * S))] == [2, 3, 4, 5]
    assert got(counters.raw_rate(phase, 0, 6 * S)) == [(i + 0.374, 100.0) for i in range(1, 6)]


def test_samples_of_one_time(spark):
    c = samples(spark, [({}, [(0, 0), (1, 10), (1, 30), (2, 40)])])
    # The tick at 1 is met by the first sample there; later ticks go on from the last.
    assert got(counters.rate(c.withColumn("raw_t", F.col("t") + F.col("v")), S, 0, 3 * S)) == [(1, 10.0), (2, 30.0)]
    two = samples(spark, [({}, [(1, 5), (1, 7), (2, 17)])])
    assert got(counters.rate(two.withColumn("raw_t", F.col("t") + F.col("v")), S, 0, 3 * S)) == [(2, 12.0)]


def test_rate_band(spark):
    c = samples(spark, [({}, [(1, 0, 1.00, 1.02), (2, 100, 1.98, 2.00), (3, 200, 2.98, 3.00)])])
    out = counters.rate(c, S, 2 * S, 2 * S, S)
    assert got(out) == [(2, 100.0)] and band(out) == [(100.0, 104.1667)]


def test_second_derivative_at_epoch_scale(spark):
    base = 1_700_000_000
    c = samples(spark, [({}, [(base + i, 5 * i * i) for i in range(8)])])
    out = got(counters.second_derivative(c, S, (base + 4) * S, (base + 5) * S))
    assert [v for _, v in out] == [10.0, 10.0]


def test_gauges(spark):
    g = samples(spark, [({}, [(1000 + i, 10 * (i + 1)) for i in range(5)])])
    assert got(gauges.avg_over_time(g, 3 * S, S, 1002 * S, 1002 * S)) == [(1002, 20.0)]
    assert got(gauges.avg_over_time(g, 5 * S, S, 1004 * S, 1004 * S)) == [(1004, 30.0)]
    assert got(gauges.last(g, 2 * S, 1000 * S, 1004 * S, S)) == [(1000, 10.0), (1002, 30.0), (1004, 50.0)]
    assert got(gauges.idelta(g, 3 * S, S, 1002 * S, 1003 * S)) == [(1002, 10.0), (1003, 10.0)]
    assert got(gauges.deriv(g, S, 1002 * S, 1003 * S)) == [(1002, 10.0), (1003, 10.0)]
    assert len(got(gauges.raw(g, S, 1002 * S, 1004 * S, S))) == 4  # one from before the start


def test_gauge_goes_stale(spark):
    g = samples(spark, [({}, [(0, 1), (5, 2)])])
    assert got(gauges.last(g, S, 0, 6 * S, S)) == [(0, 1.0), (1, 1.0), (5, 2.0), (6, 2.0)]


def test_aggregates(spark):
    three = samples(spark, [({"n": x, "s": "user"}, [(1000 + i, b + 100 * i) for i in range(3)]) for x, b in (("a", 100), ("b", 200), ("c", 300))])
    rate = counters.rate(three, S, 1001 * S, 1002 * S)
    assert got(aggregate.aggregate(rate, "sum", by=["s"]), "s") == [("user", 1001, 300.0), ("user", 1002, 300.0)]
    assert len(got(aggregate.aggregate(rate, "sum", without=["s"]))) == 6
    assert got(aggregate.aggregate(rate, "count")) == [(1001, 3.0), (1002, 3.0)]
    g = gauges.last(three, S, 1000 * S, 1000 * S, S)
    for op, v in (("min", 100.0), ("max", 300.0), ("avg", 200.0)):
        assert got(aggregate.aggregate(g, op)) == [(1000, v)]


def test_aggregate_bands(spark):
    rows = [("a", {"x": "a"}, 1, 10.0, 9.0, 11.0), ("b", {"x": "b"}, 1, 20.0, 18.0, 22.0)]
    p = spark.createDataFrame(rows, "series string, labels map<string,string>, t long, v double, lo double, hi double")
    assert band(aggregate.aggregate(p, "sum")) == [(27.0, 33.0)]
    assert band(aggregate.aggregate(p, "avg")) == [(13.5, 16.5)]
    assert band(aggregate.aggregate(p, "min")) == [None]


def test_binary_between_series(spark):
    total, available, reserved = (samples(spark, [({}, [(1000 + i, f(i)) for i in range(5)])]) for f in (lambda i: 1000, lambda i: 800 - 100 * i, lambda i: 50))
    g = lambda x: gauges.last(x, 2 * S, 1000 * S, 1004 * S, S)
    used = binary.series(g(total), g(available), "-")
    assert [v for _, v in got(used)] == [200.0, 400.0, 600.0]
    assert [v for _, v in got(binary.series(used, g(reserved), "-"))] == [150.0, 350.0, 550.0]


def test_matching(spark):
    tx = samples(spark, [({"iface": i, "direction": "tx"}, [(1, v)]) for i, v in (("e0", 100), ("e1", 200))])
    bw = samples(spark, [({"iface": i}, [(1, v)]) for i, v in (("e0", 1000), ("e1", 2000))])
    a, b = gauges.last(tx, S, S, S, S), gauges.last(bw, S, S, S, S)
    assert got(binary.series(a, b, "/", ignoring=["direction"]), "iface") == [("e0", 1, 0.1), ("e1", 1, 0.1)]
    assert len(got(binary.series(a, b, "/", on=["iface"]))) == 2
    assert got(binary.series(a, b, "/")) == []


def test_single_right_series_meets_all(spark):
    cpu = samples(spark, [({"cpu": c}, [(1000 + i, 100 * i) for i in range(3)]) for c in "01"])
    cores = samples(spark, [({"node": "n", "source": "s"}, [(1000 + i, 4) for i in range(3)])])
    busy = aggregate.aggregate(counters.rate(cpu, S, 1002 * S, 1002 * S, 5 * S), "sum")
    out = binary.series(busy, gauges.last(cores, S, 1002 * S, 1002 * S, S), "/")
    assert got(out) == [(1002, 50.0)]


def test_scalars_and_zero(spark):
    g = gauges.last(samples(spark, [({}, [(1, 10), (2, 0)])]), S, S, 2 * S, S)
    assert got(binary.scalar(g, "/", 4)) == [(1, 2.5), (2, 0.0)]
    assert got(binary.scalar(g, "/", 5, number_first=True)) == [(1, 0.5)]
    assert math.isnan(binary.numbers("/", 1, 0)) and binary.numbers("+", 1, 2) == 3


def test_bands_of_one_read_and_two(spark):
    schema = "series string, labels map<string,string>, t long, v double, lo double, hi double, e_lb double, e_le double, e_rb double, e_re double"
    point = lambda v, lo, hi, shift=0.0: [("{}", {}, 1, v, lo, hi, 0.0 + shift, 0.01 + shift, 1.0 + shift, 1.01 + shift)]
    a = spark.createDataFrame(point(100.0, 99.0, 101.0), schema)
    same = spark.createDataFrame(point(50.0, 49.0, 51.0), schema)
    other = spark.createDataFrame(point(50.0, 49.0, 51.0, 0.01), schema)
    lo, hi = band(binary.series(a, same, "/"))[0]
    assert (lo, hi) == (round(99 / 51, 4), round(101 / 49, 4))
    lo2, hi2 = band(binary.series(a, other, "/"))[0]
    assert lo2 < lo and hi2 > hi
    zero = spark.createDataFrame(point(0.1, -4.0, 4.0), schema)
    out = binary.series(spark.createDataFrame([("{}", {}, 1, 10.0)], "series string, labels map<string,string>, t long, v double"), zero, "/")
    assert [v for _, v in [(r["t"], round(r["v"], 6)) for r in out.collect()]] == [100.0] and band(out) == [None]


def hist(spark, series):
    rows = [(labels, int(t * S), [(i, c) for i, c in b]) for labels, ticks in series for t, b in ticks]
    df = spark.createDataFrame(rows, "labels map<string,string>, t long, buckets array<struct<idx:int,cnt:bigint>>")
    return df.withColumn("series", L.canonical(F.col("labels")))


def test_histograms(spark):
    h = hist(spark, [({"cpu": c}, [(1000 + i, [(10, n)] if n else []) for i, n in enumerate((0, 5, 12))]) for c in "01"])
    a, z = 1000 * S, 1002 * S
    assert [v for _, v in got(histogram.count(h, a, z))] == [10.0, 14.0]
    assert [v for _, v in got(histogram.mean(h, 4, a, z))] == [10.0, 10.0]
    assert [v for _, v in got(histogram.total(h, 4, a, z))] == [100.0, 140.0]
    assert got(histogram.total(h, 4, a, z, by=["cpu"]), "cpu") == [("0", 1001, 50.0), ("0", 1002, 70.0), ("1", 1001, 50.0), ("1", 1002, 70.0)]
    q = histogram.quantiles(h, [0.5, 1], 4, a, z)
    assert got(q, "quantile") == [("0.5", 1001, 10.0), ("0.5", 1002, 10.0), ("1", 1001, 10.0), ("1", 1002, 10.0)]
    assert [r["cnt"] for r in histogram.heatmap(h, 4, a, z).orderBy("t").collect()] == [10, 14]
    assert [v for _, v in got(histogram.irate(h, a, z))] == [14.0]
    assert got(histogram.count(h, z, z)) == []  # a single tick has nothing before it
    with pytest.raises(ValueError):
        histogram.quantiles(h, [1.5], 4, a, z)


def test_histogram_irate_keeps_zeros(spark):
    h = hist(spark, [({}, [(i, [(1, n)]) for i, n in enumerate((5, 10, 110, 110, 110))])])
    assert [v for _, v in got(histogram.irate(h, 0, 4 * S))] == [100.0, 0.0, 0.0]


def test_histogram_gaps(spark):
    h = hist(spark, [({}, [(0, [(1, 4)]), (1, []), (2, [(1, 6)]), (3, [(1, 5), (2, 3)])])])
    assert got(histogram.count(h, 0, 3 * S)) == [(2, 6.0), (3, 3.0)]


def strides(ticks, stride, sizes, **how):
    """(tick, shown at), with the ticks given in batches of ``sizes``."""
    batches, at = [], 0
    for n in [*sizes, len(ticks)]:
        part = ticks[at : at + n]
        batches.append((np.array([t for t, _ in part], np.int64), np.array([h for _, h in part], bool)))
        at += n
    return [(int(t), int(x)) for some, x in histogram.emit_times(iter(batches), stride, **how) for t in some]


def one_by_one(ticks, stride, only_with_data=False):
    out, last, waiting, data = [], None, [], False
    for t, has in ticks:
        waiting.append(t)
        data = data or has
        if last is None:
            last = t
        elif t - last >= stride and (data or not only_with_data):
            out += [(x, t) for x in waiting]
            last, waiting, data = t, [], False
    return out + [(x, waiting[-1]) for x in waiting]


def test_strides():
    ticks = [(i, i > 0) for i in range(6)]
    assert strides(ticks, 2, [6]) == [(0, 2), (1, 2), (2, 2), (3, 4), (4, 4), (5, 5)]
    quiet = [(0, False), (1, False), (2, False), (3, True), (4, True)]
    assert strides(quiet, 2, [5])[:3] == [(0, 2), (1, 2), (2, 2)]
    assert strides(quiet, 2, [5], only_with_data=True) == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 4)]
    rng = np.random.default_rng(0)
    for _ in range(300):
        times = np.unique(rng.integers(0, 60, rng.integers(0, 30))).tolist()
        some = [(t, bool(rng.random() < 0.3)) for t in times]
        stride, sizes, only = int(rng.integers(1, 12)), rng.integers(0, 6, 8).tolist(), bool(rng.random() < 0.5)
        assert strides(some, stride, sizes, only_with_data=only) == one_by_one(some, stride, only)


def test_strided_count(spark):
    h = hist(spark, [({}, [(i, [(1, 2 * i)]) for i in range(5)])])
    assert got(histogram.count(h, 0, 4 * S, stride=2 * S)) == [(2, 4.0), (4, 4.0)]


def test_bucket_geometry(spark):
    p = 4
    df = spark.createDataFrame([(v,) for v in (0, 31, 32, 33, 63, 64, 65_535)], "v long").withColumn("i", h2.bucket_index(F.col("v"), p))
    rows = df.select("v", "i", h2.bucket_start(F.col("i"), p).alias("a"), h2.bucket_end(F.col("i"), p).alias("z")).collect()
    assert [r["i"] for r in rows] == [0, 31, 32, 32, 47, 48, 207]
    assert all(r["a"] <= r["v"] <= r["z"] for r in rows)
    assert h2.total_buckets(4, 16) == 208 and h2.total_buckets(1, 3) == 6


def test_labels(spark):
    df = spark.createDataFrame([({"a": "x"},), ({"a": "y.z"},), ({"b": "x"},)], "labels map<string,string>")
    n = lambda *m: df.where(L.matches(F.col("labels"), list(m))).count()
    assert n(("a", "=", "x")) == 1 and n(("a", "!=", "x")) == 2
    assert n(("a", "=~", r"(x|y\.z)")) == 2 and n(("a", "!~", "x|q")) == 2
    assert n(("a", "=", "q"), ("a", "=", "x")) == 1 and n(("a", "=~", "x.*")) == 0


def test_display(spark):
    rows = [("s", {}, i * 60 * S, float(10 * (i + 1))) for i in range(5)]
    p = spark.createDataFrame(rows, "series string, labels map<string,string>, t long, v double")
    r = display.boxplot(p, 1).collect()
    assert [(x["t"], x["min"], x["lo"], x["median"], x["hi"], x["max"]) for x in r] == [(0, 10.0, 20.0, 30.0, 40.0, 50.0)]
    wide = display.boxplot(p, 1, "wide").collect()[0]
    assert (round(wide["lo"], 6), round(wide["hi"], 6)) == (14.0, 46.0)
    assert display.boxplot(p, 0).count() == 5 and display.boxplot(p, 5).count() == 5


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_order_and_partitions_do_not_matter(spark, parts):
    c = samples(spark, [({"k": str(k)}, [(i + 0.3 * k, (i * 37 * (k + 1)) % 90) for i in range(12)]) for k in range(3)])
    out = got(counters.rate(c.orderBy(F.rand(parts)).repartition(parts), 2 * S, 0, 12 * S), "k")
    assert out == got(counters.rate(c, 2 * S, 0, 12 * S), "k") and out


def test_slopes_are_hashed_not_sorted(spark):
    """Each sample is in several ticks; sorting them before they are summed takes memory with the input."""
    rows = samples(spark, [({"b": "y", "a": "x"}, [(i, i * i) for i in range(20)]), ({}, [(i, i) for i in range(20)])])
    out = counters.second_derivative(rows, 2 * S, 0, 19 * S)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    made = out.collect()
    assert {tuple(sorted(r["labels"].items())) for r in made} == {(("a", "x"), ("b", "y")), ()}
    assert {round(r["v"], 9) for r in made if not r["labels"]} == {0.0}
    assert {round(r["v"], 9) for r in made if r["labels"]} == {2.0}
