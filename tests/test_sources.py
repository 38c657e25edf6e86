"""Recordings as files, and several sources as one."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegrid.frames import SECOND
from tidegrid.functions import labels as L
from tidegrid.operators import counters, gauges, histogram
from tidegrid.sources import compose, exposition, recording, schema

S = SECOND


def write(path, columns, interval_ms=1000, **about):
    """columns: [(name, arrow type, values, metadata)]; timestamps are the first."""
    fields = [pa.field(n, t, metadata=m) for n, t, _, m in columns]
    meta = {"sampling_interval_ms": str(interval_ms)} | about
    table = pa.table([pa.array(v, t) for _, t, v, _ in columns], schema=pa.schema(fields, metadata=meta))
    pq.write_table(table, path)
    return str(path)


U, I, LIST = pa.uint64(), pa.int64(), pa.list_(pa.uint64())


def counter(name, values, **labels):
    return name, U, values, {"metric": name.split("/")[0], "metric_type": "counter"} | labels


def stamps(*seconds):
    return "timestamp", U, [int(x * S) for x in seconds], None


@pytest.fixture
def wide(tmp_path):
    return write(
        tmp_path / "a.parquet",
        [
            stamps(1, 2, 3, 4),
            counter("requests/0", [10, 20, 35, 50], cpu="0"),
            counter("requests/1", [0, 5, None, 9], cpu="1"),
            ("temp", I, [5, -6, 7, 8], {"metric": "temp", "unit": "celsius"}),
            ("lat:buckets", LIST, [[0, 2, 0], [0, 5, 1], None, [0, 6, 2]], {"metric": "lat", "grouping_power": "1", "max_value_power": "3"}),
            ("sp:bucket_indices", LIST, [[1], [1, 2]] + [[1, 2]] * 2, {"metric": "sp", "grouping_power": "1", "max_value_power": "3"}),
            ("sp:bucket_counts", LIST, [[4], [6, 1]] + [[6, 3]] * 2, None),
            ("nolayout:buckets", LIST, [[1]] * 4, {"metric": "nolayout"}),
        ],
        source="probe",
    )


def points(df):
    return [(r["t"] / S, round(r["v"], 6)) for r in df.orderBy("series", "t").collect()]


def test_catalog_and_rows(spark, wide):
    rec = recording.open_recording(wide)
    assert rec.interval_ns == S and rec.metadata["source"] == "probe"
    cat = recording.catalog(spark, [rec])
    assert [tuple(r) for r in schema.names(cat).collect()] == [("histogram", "lat"), ("counter", "requests"), ("histogram", "sp"), ("gauge", "temp")]
    assert [tuple(r) for r in schema.label_values(cat, "requests").collect()] == [("cpu", "0"), ("cpu", "1")]
    assert {r["metric"]: r["n"] for r in schema.series_count(cat).collect()} == {"lat": 1, "requests": 2, "sp": 1, "temp": 1}
    assert [r["column_name"] for r in schema.columns(cat, [("cpu", "=", "1")], "req.*").collect()] == ["requests/1"]
    rows = recording.long_table(spark, [rec])
    assert rows.where("kind = 'counter'").count() == 7 and rows.where("metric = 'lat'").count() == 4
    assert tuple(schema.time_range(rows).first()) == (S, 4 * S)
    got = schema.select(rows, "counter", "requests", [("cpu", "=", "0")])
    assert points(counters.rate(got, S, 2 * S, 4 * S)) == [(2, 10.0), (3, 15.0), (4, 15.0)]
    assert points(gauges.last(schema.select(rows, "gauge", "temp"), S, S, 2 * S, S)) == [(1, 5.0), (2, -6.0)]
    with pytest.raises(KeyError):
        schema.select(rows, "gauge", "requests")


def test_histograms_dense_sparse_and_null_cells(spark, wide):
    rows = recording.long_table(spark, [recording.open_recording(wide)], kinds=("histogram",))
    # The tick after a null cell counts from nothing.
    assert points(histogram.count(rows.where("metric = 'lat'"), 0, 4 * S)) == [(2, 4.0), (4, 8.0)]
    assert points(histogram.count(rows.where("metric = 'sp'"), 0, 4 * S)) == [(2, 3.0), (3, 2.0)]


def test_two_layouts_of_one_histogram(tmp_path):
    both = [("h/a", LIST, [[1]], {"metric": "h", "grouping_power": p, "max_value_power": "8"}) for p in ("2", "3")]
    path = write(tmp_path / "x.parquet", [stamps(1), *both[:1], ("h/b", *both[1][1:])])
    with pytest.raises(ValueError):
        recording.open_recording(path)


def window_of(spark, path):
    rows = recording.long_table(spark, [recording.open_recording(path)], kinds=("counter",), metric="c")
    return [(r["t"], r["raw_t"], r["w_begin"], r["w_end"]) for r in rows.orderBy("raw_t").collect()]


def test_read_windows(spark, tmp_path):
    side = [("c:window_begin", I, [-50_000_000, -40_000_000], None), ("c:window_width", U, [30_000_000, 20_000_000], None)]
    table = [(n.removeprefix("c"), *rest) for n, *rest in side]
    values = counter("c", [100, 400])
    want = [(S, S, 950_000_000, 980_000_000), (2 * S, 2 * S, 1_960_000_000, 1_980_000_000)]
    for k, extra in enumerate((side, table)):
        assert window_of(spark, write(tmp_path / f"w{k}.parquet", [stamps(1, 2), values, *extra])) == want
    off = window_of(spark, write(tmp_path / "off.parquet", [stamps(1.0005, 2.0003), values, *side]))
    assert off == [(S, 1_000_500_000, 950_500_000, 980_500_000), (2 * S, 2_000_300_000, 1_960_300_000, 1_980_300_000)]
    duration = ("duration", U, [30_000_000, 20_000_000], None)
    assert [w[2:] for w in window_of(spark, write(tmp_path / "d.parquet", [stamps(1, 2), values, duration]))] == [(S, 1_030_000_000), (2 * S, 2_020_000_000)]
    assert [w[2:] for w in window_of(spark, write(tmp_path / "n.parquet", [stamps(1, 2), values]))] == [(None, None)] * 2


def test_normalized_table_is_pruned(spark, wide, tmp_path):
    path = str(tmp_path / "long")
    recording.normalize(spark, [recording.open_recording(wide)], path)
    rows = spark.read.parquet(path)
    assert rows.count() == 19
    plan = schema.select(rows, "counter", "requests").where("raw_t >= 3000000000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(raw_t" in plan


def test_injected_labels(spark, tmp_path):
    files = [write(tmp_path / f"{z}.parquet", [stamps(1, 2), counter("requests", [0, 10])]) for z in ("east", "west")]
    recs = [recording.open_recording(f, i).with_labels(zone=z) for i, (f, z) in enumerate(zip(files, ("east", "west")))]
    rows = recording.long_table(spark, recs)
    assert schema.select(rows, "counter", "requests", [("zone", "=", "west")]).count() == 2
    bare = recording.long_table(spark, [recording.open_recording(files[0])])
    assert {r["labels"]["zone"] for r in compose.labelled(bare, zone="north").collect()} == {"north"}


def segment(spark, times, values, kind="counter", metric="c", windows=False, labels=None):
    rows = [(kind, metric, labels or {}, int(t * S), v, int(t * S) if windows else None, int(t * S) + 1 if windows else None) for t, v in zip(times, values)]
    df = spark.createDataFrame(rows, "kind string, metric string, labels map<string,string>, t long, v long, w_begin long, w_end long")
    return df.withColumns({"raw_t": F.col("t"), "series": L.canonical(F.col("labels"))})


def test_splice(spark):
    a, b = segment(spark, (1, 2), (10, 20)), segment(spark, (3, 4), (35, 50))
    whole = segment(spark, (1, 2, 3, 4), (10, 20, 35, 50))
    rate = lambda x: points(counters.rate(x, S, S, 4 * S))
    assert rate(compose.spliced(a, b)) == rate(whole) == [(2, 10.0), (3, 15.0), (4, 15.0)]
    assert rate(compose.side_by_side(a, b)) == [(2, 10.0), (4, 15.0)]
    with pytest.raises(ValueError):
        compose.spliced()
    banded = lambda *x: counters.rate(compose.spliced(*x), S, S, 4 * S).where("lo is not null").count()
    wa, wb = segment(spark, (1, 2), (10, 20), windows=True), segment(spark, (3, 4), (35, 50), windows=True)
    assert banded(wa, wb) == 3 and banded(wa, b) == 0


def layout(spark, times, counts, p):
    rows = [("histogram", "h", {}, int(t * S), [(1, c)], p, 8) for t, c in zip(times, counts)]
    df = spark.createDataFrame(rows, "kind string, metric string, labels map<string,string>, t long, buckets array<struct<idx:int,cnt:bigint>>, p int, n int")
    extra = {c: F.lit(None).cast("long") for c in ("v", "w_begin", "w_end")}
    return df.withColumns({"raw_t": F.col("t"), "series": L.canonical(F.col("labels"))} | extra)


def test_runs_of_bucket_layouts(spark):
    a, b = layout(spark, (1, 2), (1, 4), 2), layout(spark, (3, 4), (2, 7), 3)
    both = compose.spliced(a, b)
    count = lambda x: points(histogram.count(x, 0, 9 * S))
    assert count(compose.one_run(both)) == count(compose.one_run(both, 0)) == count(a) == [(2, 3.0)]
    assert count(compose.one_run(both, 1)) == count(b) == [(4, 5.0)]
    same = compose.spliced(a, layout(spark, (3, 4), (6, 7), 2))
    assert count(compose.one_run(same, 0)) == [(2, 3.0), (3, 2.0), (4, 1.0)]


def test_disjoint(spark):
    a, b, c = segment(spark, (1, 2), (1, 2)), segment(spark, (1, 2), (5, 9), metric="d"), segment(spark, (1, 2), (7, 8))
    both = compose.disjoint(a, b)
    rate = lambda m: counters.rate(schema.select(both, "counter", m), S, S, 2 * S)
    assert points(rate("c")) == [(2, 1.0)] and points(rate("d")) == [(2, 4.0)]
    with pytest.raises(ValueError, match="counter c"):
        compose.disjoint(a, c)
    assert [r["v"] for r in compose.disjoint(a, c, strict=False).orderBy("t").collect()] == [1, 2]
    assert compose.finest_interval(5, 2) == 2


def cells(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("by_spark", [True, False])
def test_written_recordings_read_back(spark, tmp_path, sparse, by_spark):
    """Kinds, labels, windows, buckets, layouts, interval and metadata, by the footer or by Spark's schema."""
    rows = segment(spark, (1, 2, 3), (3, 4, 9), labels={"a": 'q"x', "b": "{1}"}, windows=True)
    rows = rows.unionByName(segment(spark, (1, 2), (5, None), kind="gauge", metric="g.h")).unionByName(segment(spark, (2,), (7,), metric="c"))
    rows = rows.unionByName(layout(spark, (1, 2, 3), (1, 4, 9), 2).select(*rows.columns, "buckets", "p", "n"), allowMissingColumns=True)
    path = str(tmp_path / "w")
    recording.write_wide(rows, path, 500, sparse, source="probe", version="1.2")
    rec = recording.open_recording(path, spark=spark if by_spark else None)
    assert (rec.interval_ns, rec.source, rec.version, rec.filename, rec.metadata["source"]) == (S // 2, "probe", "1.2", "w", "probe")
    back = recording.long_table(spark, [rec])
    same = ("kind", "metric", "labels", "t", "raw_t", "v", "w_begin", "w_end", "p", "n")
    assert cells(back, *same) == cells(rows.where("v is not null or kind = 'histogram'"), *same)
    buckets = F.coalesce("buckets", F.array().cast("array<struct<idx:int,cnt:bigint>>"))
    assert cells(back.where("kind = 'histogram'"), "t", "buckets") == cells(rows.where("kind = 'histogram'"), "t", buckets)
    assert points(histogram.count(back.where("kind = 'histogram'"), 0, 9 * S)) == [(2, 3.0), (3, 5.0)]
    again = str(tmp_path / "again")
    recording.write_wide(back, again, 500, sparse)
    assert cells(recording.long_table(spark, [recording.open_recording(again)]), *same) == cells(back, *same)


def test_wide_tables_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recording, "MAX_SERIES", 1)
    two = segment(spark, (1,), (3,)).unionByName(segment(spark, (1,), (3,), metric="d"))
    with pytest.raises(ValueError, match="series"):
        recording.write_wide(two, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="unit"):
        recording.write_wide(segment(spark, (1,), (3,), labels={"unit": "s"}), str(tmp_path / "w"))


def test_recordings_without_matching_labels_are_not_read(spark, tmp_path):
    paths = [write(tmp_path / f"{z}.parquet", [stamps(1, 2), counter("requests/0", [0, 10], cpu="0"), counter("requests/1", [0, 5], cpu="1")]) for z in ("east", "west")]
    recs = [recording.open_recording(f, i).with_labels(zone=z) for i, (f, z) in enumerate(zip(paths, ("east", "west")))]
    some = [r.matching([("zone", "=", "west"), ("cpu", "!=", "1")]) for r in recs]
    assert [[c.column for c in r.columns] for r in some] == [[], ["requests/0"]]
    rows = recording.long_table(spark, some)
    assert {r["v"] for r in rows.collect()} == {0, 10} and rows.inputFiles()[0].endswith("west.parquet") and len(rows.inputFiles()) == 1


def test_raw_times_keep_repeats_and_order(spark, tmp_path):
    a = write(tmp_path / "a.parquet", [("timestamp", U, [3 * S, 1 * S, None, 1 * S], None), counter("c", [1, 2, 3, 4])])
    recs = [recording.open_recording(a, 1), recording.open_recording(a, 0)]
    got = [(r["file_id"], r["raw_t"]) for r in recording.sample_times(spark, recs).collect()]
    assert got == [(i, t * S) for i in (0, 1) for t in (3, 1, 1)]


def test_summaries_in_text(spark):
    hist = layout(spark, (1, 2), (1, 4), 2).withColumn("v", F.lit(None).cast("long"))
    more = hist.withColumn("buckets", F.expr("array(named_struct('idx', 1, 'cnt', cast(3 as bigint)), named_struct('idx', 9, 'cnt', cast(1 as bigint)))"))
    text = [r["line"] for r in exposition.lines(more, p=2, percentiles=[0.5, 0.99]).orderBy("metric", "place", "line").collect()]
    assert text == ["# TYPE h summary", 'h{quantile="0.5"} 1 2000', 'h{quantile="0.99"} 11 2000', "h_count 4 2000", "h_sum 13 2000"]
    assert [r["line"] for r in exposition.lines(hist.withColumn("buckets", F.array().cast("array<struct<idx:int,cnt:bigint>>")), p=2, percentiles=[0.5]).orderBy("place", "line").collect()] == ["# TYPE h summary", "h_count 0 2000", "h_sum 0 2000"]


def test_text(spark):
    rows = segment(spark, (1, 2), (3, 4), labels={"a": 'q"x'}).unionByName(segment(spark, (1, 2), (5, None), kind="gauge", metric="g.h"))
    none = F.lit(None).cast("array<struct<idx:int,cnt:bigint>>")
    text = [r["line"] for r in exposition.lines(rows.where("v is not null").withColumn("buckets", none)).orderBy("metric", "place").collect()]
    assert text == ["# TYPE c counter", 'c{a="q\\"x"} 4 2000', "# TYPE g_h gauge", "g_h 5 1000"]
    hist = layout(spark, (1, 2), (1, 4), 2).withColumn("v", F.lit(None).cast("long"))
    assert "h_count 4 2000" in [r["line"] for r in exposition.lines(hist, p=2).collect()]
