"""Wide recordings: a row per tick, a column per series; read into long tables, and written.

A column's kind comes from its type: an unsigned long is a counter, a long a gauge, a list a histogram. Its
name and labels are field metadata. The files' footers are read for that on the driver; the data are
unpivoted by Spark, and ``normalize`` writes them once so that later scans prune by kind, metric and time.
Spark knows no unsigned longs, so a recording that it wrote says each column's kind in the metadata.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.frames import SECOND
from tidegrid.functions import h2
from tidegrid.functions import labels as L

#: Field metadata that isn't a label.
NOT_LABELS = {"metric", "metric_type", "unit", "grouping_power", "max_value_power"}
BEGIN, WIDTH, BUCKETS = ":window_begin", ":window_width", ":buckets"
INDICES, COUNTS = ":bucket_indices", ":bucket_counts"
RESERVED = {"timestamp", ":wall_offset"}
#: Column that tells one recording of several from the others.
FILE = "file_id"
KINDS = ("counter", "gauge", "histogram")
#: Where Spark keeps the schema, with its columns' metadata, in a file that it writes.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
#: The most series that a wide table is written with.
MAX_SERIES = 20_000


@dataclass(frozen=True)
class Column:
    """What a recording's footer says of one series."""

    metric: str
    kind: str
    labels: tuple[tuple[str, str], ...]
    column: str
    powers: tuple[int, int] | None = None
    counts: str | None = None  # second column of a sparse histogram
    window: tuple[str, str] | None = None  # columns of the read's begin (an offset) and width


@dataclass(frozen=True)
class Recording:
    path: str
    columns: tuple[Column, ...]
    interval_ns: int
    metadata: dict[str, str] = field(default_factory=dict)
    has_duration: bool = False
    file_id: int = 0

    def with_labels(self, **labels: str) -> Recording:
        """The recording with labels put onto every series; a series' own label of that name is replaced."""
        add = lambda c: replace(c, labels=tuple(sorted((dict(c.labels) | labels).items())))
        return replace(self, columns=tuple(add(c) for c in self.columns))

    def matching(self, matchers: list[tuple[str, str, str]]) -> Recording:
        """The recording with the columns whose labels, those put on too, match; without any it isn't read at all."""
        return replace(self, columns=tuple(c for c in self.columns if L.held(dict(c.labels), matchers)))

    @property
    def source(self) -> str:
        return self.metadata.get("source", "")

    @property
    def version(self) -> str:
        return self.metadata.get("version", "")

    @property
    def filename(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]


def _kind(t: pa.DataType) -> str | None:
    if pa.types.is_uint64(t):
        return "counter"
    if pa.types.is_int64(t):
        return "gauge"
    return "histogram" if pa.types.is_list(t) and pa.types.is_uint64(t.value_type) else None


def _footer(path: str) -> tuple[list[tuple[str, str | None, dict[str, str]]], dict[str, str]]:
    """([(column, its kind, its metadata)], the file's metadata) of a file, or of the first file of a folder."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        at = min(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.path.endswith(".parquet"))
    with fs.open_input_file(at) as f:
        schema = pq.read_schema(f)
    about = schema.metadata or {}
    if SPARK_SCHEMA in about:
        return _written(json.loads(about[SPARK_SCHEMA])["fields"])
    plain = {k.decode(): v.decode() for k, v in about.items() if not k.startswith(b"ARROW:")}
    own = lambda f: {k.decode(): v.decode() for k, v in (f.metadata or {}).items() if not k.startswith(b"PARQUET:")}
    return [(f.name, _kind(f.type), own(f)) for f in schema], plain


def _written(fields: list[dict]) -> tuple[list[tuple[str, str | None, dict[str, str]]], dict[str, str]]:
    """What ``_footer`` gives, of the fields of Spark's schema; the file's metadata are those of its timestamps."""
    known = [(f["name"], {k: str(v) for k, v in f["metadata"].items()}) for f in fields]
    columns = [(name, m.get("metric_type") if m.get("metric_type") in KINDS else None, m) for name, m in known]
    return columns, dict(known).get("timestamp", {})


def open_recording(path: str, file_id: int = 0, spark: SparkSession | None = None) -> Recording:
    """Read the footer of a recording, a file or a folder of ``write_wide``; no data.

    spark: ask Spark for the schema of a recording that it wrote, where only Spark reaches the path.
    """
    if spark is None:
        fields, about = _footer(path)
    else:
        fields, about = _written([f.jsonValue() for f in spark.read.parquet(path).schema])
    names = {name for name, _, _ in fields}

    def window(base: str) -> tuple[str, str] | None:
        for prefix in (base, ""):
            if {prefix + BEGIN, prefix + WIDTH} <= names:
                return prefix + BEGIN, prefix + WIDTH
        return None

    columns, taken = [], {}
    for name, kind, meta in fields:
        if name in RESERVED or name.endswith((BEGIN, WIDTH, COUNTS)):
            continue
        sparse = name.endswith(INDICES)
        base = name.removesuffix(BUCKETS).removesuffix(INDICES)
        powers = (int(meta["grouping_power"]), int(meta["max_value_power"])) if {"grouping_power", "max_value_power"} <= meta.keys() else None
        if kind is None or (kind == "histogram" and powers is None):
            continue
        labels = tuple(sorted((k, v) for k, v in meta.items() if k not in NOT_LABELS))
        metric = meta.get("metric", base)
        if kind == "histogram" and taken.setdefault((metric, labels), powers) != powers:
            raise ValueError(f"{metric} has two bucket layouts in {path}")
        columns.append(Column(metric, kind, labels, name, powers, base + COUNTS if sparse else None, window(base)))
    interval = int(about.get("sampling_interval_ms", "1000")) * (SECOND // 1000)
    return Recording(path, tuple(columns), interval, about, "duration" in names, file_id)


def catalog(spark: SparkSession, recordings: list[Recording]) -> DataFrame:
    """metric, kind, series, labels, column_name, file_id, p, n: a row for each series of each recording."""
    rows = [
        (c.metric, c.kind, dict(c.labels), c.column, r.file_id, *(c.powers or (None, None))) for r in recordings for c in r.columns
    ]
    table = spark.createDataFrame(rows, "metric string, kind string, labels map<string,string>, column_name string, file_id int, p int, n int")
    return table.withColumn("series", L.canonical(F.col("labels")))


def _snapped(raw, interval: int):
    return F.expr(f"(raw_t + {interval // 2}) div {interval} * {interval}") if interval else raw


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _long_rows(spark: SparkSession, rec: Recording, kinds: set[str], metric: str | None) -> DataFrame | None:
    chosen = [c for c in rec.columns if c.kind in kinds and metric in (None, c.metric)]
    if not chosen:
        return None
    wide = spark.read.parquet(rec.path).withColumn("raw_t", F.col("timestamp").cast("long"))
    duration = F.col("duration").cast("long") if rec.has_duration else F.lit(None).cast("long")
    entries = []
    for c in chosen:
        labels = F.create_map(*[F.lit(x) for kv in c.labels for x in kv]) if c.labels else F.create_map().cast("map<string,string>")
        begin = width = F.lit(None).cast("long")
        if c.window:
            begin, width = _quoted(c.window[0]).cast("long"), _quoted(c.window[1]).cast("long")
        known = c.window is not None or rec.has_duration
        from_begin = F.greatest(F.col("raw_t") + begin, F.lit(0))
        w_begin = F.when(begin.isNotNull() & width.isNotNull(), from_begin).otherwise(F.col("raw_t"))
        w_end = F.when(begin.isNotNull() & width.isNotNull(), from_begin + width).otherwise(F.col("raw_t") + F.coalesce(duration, F.lit(0)))
        if c.kind != "histogram":
            value = _quoted(c.column).cast("long").alias("v"), F.lit(None).cast("array<struct<idx:int,cnt:bigint>>").alias("buckets")
        elif c.counts:
            zipped = F.arrays_zip(_quoted(c.column).alias("idx"), _quoted(c.counts).alias("cnt"))
            value = F.lit(None).cast("long").alias("v"), F.coalesce(zipped.cast("array<struct<idx:int,cnt:bigint>>"), F.array().cast("array<struct<idx:int,cnt:bigint>>")).alias("buckets")
        else:
            dense = F.transform(_quoted(c.column), lambda x, i: F.struct(i.cast("int").alias("idx"), x.cast("long").alias("cnt")))
            value = F.lit(None).cast("long").alias("v"), F.coalesce(F.filter(dense, lambda b: b["cnt"] > 0), F.array().cast("array<struct<idx:int,cnt:bigint>>")).alias("buckets")
        p, n = c.powers or (None, None)
        entries.append(
            F.struct(
                F.lit(c.metric).alias("metric"), F.lit(c.kind).alias("kind"), labels.alias("labels"), L.canonical(labels).alias("series"), *value,
                F.when(F.lit(known), w_begin).alias("w_begin"), F.when(F.lit(known), w_end).alias("w_end"),
                F.lit(p).cast("int").alias("p"), F.lit(n).cast("int").alias("n"),
            )
        )
    rows = wide.select("raw_t", F.explode(F.array(*entries)).alias("_s")).select("raw_t", "_s.*")
    rows = rows.where(F.col("v").isNotNull() | (F.col("kind") == "histogram"))
    return rows.withColumns({"t": _snapped(F.col("raw_t"), rec.interval_ns), FILE: F.lit(rec.file_id)})


def long_table(spark: SparkSession, recordings: list[Recording], kinds: tuple[str, ...] = ("counter", "gauge", "histogram"), metric: str | None = None) -> DataFrame:
    """All series of the recordings as rows: kind, metric, series, labels, file_id, t, raw_t, v, buckets, w_begin, w_end, p, n."""
    parts = [x for r in recordings if (x := _long_rows(spark, r, set(kinds), metric)) is not None]
    if not parts:
        raise KeyError(metric or "no series of these kinds")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def normalize(spark: SparkSession, recordings: list[Recording], path: str) -> None:
    """Write the recordings as one long table, partitioned by kind and metric, sorted by time within files."""
    rows = long_table(spark, recordings).repartition("kind", "metric", "series").sortWithinPartitions("kind", "metric", "series", "t")
    rows.write.partitionBy("kind", "metric").mode("overwrite").parquet(path)


def sample_times(spark: SparkSession, recordings: list[Recording]) -> DataFrame:
    """file_id, place, raw_t: the time of every row as recorded, repeats too, by file and place in it."""
    out = None
    for r in recordings:
        rows = spark.read.parquet(r.path).select(
            F.lit(r.file_id).alias(FILE), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("place"), F.col("timestamp").cast("long").alias("raw_t")
        )
        out = rows if out is None else out.unionByName(rows)
    return out.where("raw_t is not null").orderBy(FILE, "_path", "place").drop("_path")


def _merged(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns that a table of counters and gauges alone may lack."""
    more = {"buckets": "array<struct<idx:int,cnt:bigint>>", "w_begin": "long", "w_end": "long", "p": "int", "n": "int"}
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in more.items() if c not in rows.columns})


def _dense(buckets, n: int):
    """The counts of all ``n`` buckets."""
    held = F.map_from_entries(buckets)
    counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(held[i], F.lit(0).cast("long")))
    return F.when(buckets.isNotNull(), counts)


def write_wide(rows: DataFrame, path: str, interval_ms: int = 1000, sparse: bool = True, **metadata: str) -> None:
    """Write a long table as a recording: a folder of files in order of time, a row per tick, a column per series.

    ``open_recording`` reads kinds, labels, bucket layouts, read windows, the interval and ``metadata`` back.
    Histograms are written as the indices and counts of their buckets, or, if not ``sparse``, as all buckets.
    Of several samples of a series at one time the largest is kept. A histogram without a sample at a tick
    has none there, which reads as an empty one. The series, MAX_SERIES at most, come to the driver by name.
    """
    named = _merged(rows).withColumn("column", F.concat_ws("/", "kind", "metric", "series"))
    windowed = F.max(F.col("w_begin").isNotNull() & F.col("w_end").isNotNull()).alias("windowed")
    per = named.groupBy("column").agg(*[F.first(c).alias(c) for c in ("metric", "kind", "labels")], F.max("p").alias("p"), F.max("n").alias("n"), windowed)
    about = per.orderBy("column").limit(MAX_SERIES + 1).collect()
    if len(about) > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} series for a wide table")
    if reserved := sorted({k for r in about for k in r["labels"]} & NOT_LABELS):
        raise ValueError(f"labels that a recording can't hold: {', '.join(reserved)}")
    sample = F.max(F.struct("v", F.array_sort("buckets").alias("buckets"), "w_begin", "w_end"))
    wide = named.groupBy(F.col("raw_t").alias("timestamp")).pivot("column", [r["column"] for r in about]).agg(sample)
    wide = wide.toDF("timestamp", *[f"c{i}" for i in range(len(about))])
    out = [F.col("timestamp").alias("timestamp", metadata=metadata | {"sampling_interval_ms": str(interval_ms)})]
    for i, r in enumerate(about):
        name, at = f"{r['metric']}/{i}", F.col(f"c{i}")
        meta = dict(r["labels"]) | {"metric": r["metric"], "metric_type": r["kind"]}
        if r["kind"] == "histogram":
            meta |= {"grouping_power": str(r["p"]), "max_value_power": str(r["n"])}
        if r["kind"] != "histogram":
            out.append(at["v"].alias(name, metadata=meta))
        elif sparse:
            out.append(F.transform(at["buckets"], lambda b: b["idx"].cast("long")).alias(name + INDICES, metadata=meta))
            out.append(F.transform(at["buckets"], lambda b: b["cnt"]).alias(name + COUNTS))
        else:
            out.append(_dense(at["buckets"], h2.total_buckets(r["p"], r["n"])).alias(name + BUCKETS, metadata=meta))
        if r["windowed"]:
            out.append((at["w_begin"] - F.col("timestamp")).alias(name + BEGIN))
            out.append((at["w_end"] - at["w_begin"]).alias(name + WIDTH))
    wide.select(*out).orderBy("timestamp").write.mode("overwrite").parquet(path)
