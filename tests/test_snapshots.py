"""Snapshots in their three shapes, whole and broken."""

import json

from tidegrid.frames import SECOND
from tidegrid.sources import snapshots

S = SECOND


def at(secs, nanos=0):
    return {"secs_since_epoch": secs, "nanos_since_epoch": nanos}


def hist(buckets, p=1, n=3):
    return {"config": {"grouping_power": p, "max_value_power": n}, "buckets": buckets}


V1 = {
    "systemtime": at(1, 20),
    "metadata": {},
    "counters": [{"name": "0", "value": 5, "metadata": {"metric": "hits", "cpu": "0", "unit": "x"}}],
    "gauges": [{"name": "load", "value": -3, "metadata": {}, "window": {"begin_ns": 7, "end_ns": 9}}],
    "histograms": [{"name": "lat", "value": hist([0, 4, 0, 0, 0, 1]), "metadata": {}}, {"name": "bad", "value": hist([1]), "metadata": {}}],
}
V2 = V1 | {"systemtime": at(2), "duration": {"secs": 0, "nanos": 30}, "histograms": []}
DESC = {"name": "1", "metadata": {"metric": "hits", "cpu": "1"}}
GROUP = {"name": "g", "schema_hash": [1, 2], "window": {"begin_ns": 100, "end_ns": 110}, "gauges": [], "histograms": []}
V3 = {
    "systemtime": at(3),
    "duration": {"secs": 0, "nanos": 1},
    "groups": [
        GROUP | {"schema": {"counters": [DESC, DESC | {"name": "2"}], "gauges": [], "histograms": []}, "counters": [8, None]},
        GROUP | {"schema": None, "counters": [9]},
        GROUP | {"schema": {"counters": [DESC], "gauges": [], "histograms": []}, "counters": [1, 2]},
    ],
}


def test_shapes(spark):
    lines = [json.dumps(x) for x in (V1, V2, V3)] + ["", "nonsense", "{}", "[1]"]
    rows = snapshots.long_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((r["raw_t"], r["kind"], r["metric"], str(r["labels"]), r["v"], r["w_begin"], r["w_end"]) for r in rows.collect())
    assert got == [
        (S + 20, "counter", "hits", "{'cpu': '0'}", 5, None, None),
        (S + 20, "gauge", "load", "{}", -3, 7, 9),
        (S + 20, "histogram", "lat", "{}", None, None, None),
        (2 * S, "counter", "hits", "{'cpu': '0'}", 5, 2 * S, 2 * S + 30),
        (2 * S, "gauge", "load", "{}", -3, 7, 9),
        (3 * S, "counter", "hits", "{'cpu': '1'}", 8, 100, 110),
    ]
    assert {r["t"] for r in rows.collect()} == {S, 2 * S, 3 * S}
    h = rows.where("kind = 'histogram'").first()
    assert [tuple(b) for b in h["buckets"]] == [(1, 4), (5, 1)] and (h["p"], h["n"]) == (1, 3)
