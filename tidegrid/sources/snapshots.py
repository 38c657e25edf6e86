"""Snapshots of live metrics, one JSON object a line, as rows of a long table.

Three shapes are told apart by their fields: metrics listed flat, the same with the time that reading took, and
metrics in groups that share a schema and a read window. In a group, values align with the schema by place; a
null is a metric without a reading, a group without a schema has no names, and one whose values and schema
differ in length is dropped for that kind, as are histograms whose buckets don't fit their layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.frames import SECOND
from tidegrid.functions import labels as L
from tidegrid.sources.recording import NOT_LABELS

_WINDOW = "struct<begin_ns:bigint,end_ns:bigint>"
_META = "map<string,string>"
_HIST = "struct<config:struct<grouping_power:int,max_value_power:int>,buckets:array<bigint>>"
_DESCS = f"array<struct<name:string,metadata:{_META}>>"
_VALUES = {"counters": "bigint", "gauges": "bigint", "histograms": _HIST}


def _flat(kind: str) -> str:
    return f"{kind}:array<struct<name:string,value:{_VALUES[kind]},metadata:{_META},window:{_WINDOW}>>"


SCHEMA = (
    "struct<systemtime:struct<secs_since_epoch:bigint,nanos_since_epoch:bigint>,duration:struct<secs:bigint,nanos:bigint>,"
    + ",".join(_flat(k) for k in _VALUES)
    + f",groups:array<struct<name:string,schema:struct<{','.join(f'{k}:{_DESCS}' for k in _VALUES)}>,window:{_WINDOW},"
    + ",".join(f"{k}:array<{t}>" for k, t in _VALUES.items())
    + ">>>"
)


def _readings(snaps: DataFrame, kind: str) -> DataFrame:
    """raw_t, took, name, meta, window and value of every reading of a kind."""
    flat = snaps.select("raw_t", "took", F.explode(f"s.{kind}").alias("e"))
    flat = flat.select("raw_t", "took", F.col("e.name").alias("name"), F.col("e.metadata").alias("meta"), F.col("e.window").alias("window"), F.col("e.value").alias("value"))
    groups = snaps.select("raw_t", "took", F.explode("s.groups").alias("g"))
    aligned = groups.where(F.size(f"g.schema.{kind}") == F.size(f"g.{kind}")).where(F.col(f"g.schema.{kind}").isNotNull())
    each = aligned.select("raw_t", "took", F.col("g.window").alias("window"), F.explode(F.arrays_zip(F.col(f"g.schema.{kind}").alias("d"), F.col(f"g.{kind}").alias("v"))).alias("e"))
    each = each.select("raw_t", "took", F.col("e.d.name").alias("name"), F.col("e.d.metadata").alias("meta"), "window", F.col("e.v").alias("value"))
    return flat.unionByName(each).where(F.col("value").isNotNull())


def _buckets(value: Column) -> tuple[Column, Column, Column, Column]:
    """(whether the histogram is sound, its buckets, p, n)."""
    p, n = value["config"]["grouping_power"], value["config"]["max_value_power"]
    sound = p.isNotNull() & n.isNotNull() & (p >= 0) & (n > p) & (n <= 64) & (F.size(value["buckets"]) == (n - p + 1) * F.call_function("shiftleft", F.lit(1), F.least(F.greatest(p, F.lit(0)), F.lit(24))))
    dense = F.transform(value["buckets"], lambda x, i: F.struct(i.cast("int").alias("idx"), x.alias("cnt")))
    return sound, F.filter(dense, lambda b: b["cnt"] > 0), p, n


def long_rows(lines: DataFrame, interval_ns: int = SECOND) -> DataFrame:
    """The long table of ``lines`` (value string); lines that aren't JSON objects of a snapshot give no rows."""
    parsed = lines.select(F.from_json("value", SCHEMA).alias("s")).where("s.systemtime is not null")
    nanos = lambda s, n: F.col(s) * SECOND + F.coalesce(F.col(n), F.lit(0))
    snaps = parsed.select("s", nanos("s.systemtime.secs_since_epoch", "s.systemtime.nanos_since_epoch").alias("raw_t"), nanos("s.duration.secs", "s.duration.nanos").alias("took"))
    none = F.lit(None).cast("array<struct<idx:int,cnt:bigint>>"), F.lit(None).cast("int")
    out = None
    for kind in _VALUES:
        rows = _readings(snaps, kind)
        if kind == "histograms":
            sound, buckets, p, n = _buckets(F.col("value"))
            rows = rows.where(sound)
            value = F.lit(None).cast("long").alias("v"), buckets.alias("buckets"), p.alias("p"), n.alias("n")
        else:
            value = F.col("value").alias("v"), none[0].alias("buckets"), none[1].alias("p"), none[1].alias("n")
        meta = F.coalesce("meta", F.create_map().cast(_META))
        part = rows.select(
            F.lit(kind[:-1]).alias("kind"),
            F.coalesce(meta["metric"], F.col("name")).alias("metric"),
            F.map_filter(meta, lambda k, _: ~k.isin(*NOT_LABELS)).alias("labels"),
            "raw_t",
            *value,
            F.coalesce("window.begin_ns", F.when(F.col("took").isNotNull(), F.col("raw_t"))).alias("w_begin"),
            F.coalesce("window.end_ns", F.col("raw_t") + F.col("took")).alias("w_end"),
        )
        out = part if out is None else out.unionByName(part)
    t = F.expr(f"(raw_t + {interval_ns // 2}) div {interval_ns} * {interval_ns}")
    return out.withColumns({"t": t, "series": L.canonical(F.col("labels"))})
