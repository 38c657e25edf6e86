"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions alone.

Training time runs from 0 to 1. A source's weight follows a schedule; its integral, scaled to the source's
target, is the cumulative demand for its words. The source's documents, in the order of the MD5 of id and text and
repeated pass after pass, supply words; a copy is trained on when the demand reaches its middle, so its position is the
inverse of the demand there, and words that the demand never reaches aren't taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import cut

#: A target stops at this many times its source's size, and so a document's copies.
MAX_EPOCHS = 3
#: Start and end of the schedule of each weight, between which it is linear; only their ratio matters, as a
#: schedule is scaled so that its integral over [0, 1] is the source's target. Other weights are constant.
SCHEDULES = {1: (0.5, 1.5), 2: (1.0, 1.0), 3: (1.5, 0.5)}
#: Rows that are summed up in one task when cumulative sizes are computed, on average.
ROWS_PER_BUCKET = 2_000

WHITE = r"[\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WHITE), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); one row per source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. Where a
    share is above MAX_EPOCHS times the source's size, it stops there and the rest is shared by weight again.
    The level at which that settles is found in one pass over the sources ordered by when they are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    full = F.col("source_size") * MAX_EPOCHS
    ordered = ranked.withColumn("_full", full).withColumn("_ratio", full / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = ordered.withColumn("_level", (total - before) / weights).withColumn("_i", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_i", "_level"))).over(Window.partitionBy())
    settled = first["_level"]
    target = F.least(F.col("_full").cast("double"), F.coalesce(settled, F.lit(0.0)) * F.col("weight"))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _position(share: Column, weight: Column, schedules: dict[int, tuple[float, float]]) -> Column:
    """The time at which the integral of a linear schedule has reached ``share`` of its whole."""
    out = share
    for w, (a, b) in schedules.items():
        if a != b:
            root = F.sqrt(F.lit(float(a * a)) + F.lit(float((b - a) * (a + b))) * share)
            out = F.when(weight == w, (root - F.lit(float(a))) / F.lit(float(b - a))).otherwise(out)
    return out


def _laid(docs: DataFrame, keep: list[str], id_col: str, schedules: dict[int, tuple[float, float]] | None) -> DataFrame:
    """(row, size, source_size, target, copies, taken); row: the columns to keep, as one struct.

    A source's documents are laid end to end in buckets of the order, each in a window of its own.
    """
    schedules = SCHEDULES if schedules is None else schedules
    content = F.md5(F.coalesce("text", F.lit("")))
    order = F.md5(F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), content))
    # The first 28 bits, so that buckets lie in the order; many rows of one id, or of one text, are in many buckets.
    digits = F.conv(F.substring(order, 1, 7), 16, 10).cast("long")
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col("source").alias("source"),
        count_words(F.col("text")).alias("size"),
        order.alias("_h"),
        digits.alias("_digits"),
    )
    if "text" not in keep:
        sized = cut(sized, "mix-sizes")
    n = sized.count() if "text" not in keep else docs.count()
    buckets = max(16, -(-n // ROWS_PER_BUCKET))
    sized = sized.withColumn("_bucket", F.floor(F.col("_digits") * F.lit(buckets) / F.lit(1 << 28)))
    sums = cut(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("size")), "mix-sums")
    targets = cut(source_targets(sums), "mix-targets")
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("_offset"))
    offsets = offsets.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    offsets = cut(offsets.withColumnRenamed("_bucket", "_b"), "mix-offsets")

    within = Window.partitionBy("source", "_bucket").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = sized.join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    laid = laid.withColumn("_at", F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    # The words of the j-th pass over a document that lie below the target.
    words = [
        F.least(F.col("size"), F.round("target").cast("long") - F.col("_at") - F.lit(j) * F.col("source_size")).alias("words")
        for j in range(MAX_EPOCHS)
    ]
    middles = [F.col("_at") + F.lit(j) * F.col("source_size") + words[j] / 2 for j in range(MAX_EPOCHS)]
    share = [F.least(m / F.col("target"), F.lit(1.0)) for m in middles]
    each = [F.struct(_position(share[j], F.col("weight"), schedules).alias("position"), words[j]) for j in range(MAX_EPOCHS)]
    copies = F.filter(F.array(*[F.when(words[j] > 0, each[j]) for j in range(MAX_EPOCHS)]), lambda c: c.isNotNull())
    placed = laid.withColumn("copies", copies)
    placed = placed.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda t, c: t + c["words"]))
    return placed.select("row", "size", "source_size", "target", "copies", "taken")


def _free(names: list[str], columns: list[str]) -> dict[str, str]:
    """The names under which columns made here go beside ``columns`` that are carried along: mix_ before what is taken."""
    out: dict[str, str] = {}
    for name in names:
        free = name
        while free in columns or free in out.values():
            free = f"mix_{free}"
        out[name] = free
    return out


def curriculum(
    docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", schedules: dict[int, tuple[float, float]] | None = None
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies and taken.

    copies: array<struct<position, words>>, none to MAX_EPOCHS, the training time of each copy taken and its
    words below the target; only the last copy that a source gives may be less than whole, so a source's
    taken words are its target, rounded. taken: the words of all copies. The order within a source is that
    of the MD5 of id and text, so reruns agree. schedules: by weight, as in SCHEDULES, the default.

    keep: the columns to carry along (by default doc_id alone); where one has the name of a column made here,
    that gets mix_ before its name, as often as needed. Null texts have size 0 and are never taken; texts of
    any length count whole; a null source is a source of its own; rows without an id go by their texts; ties
    and repeated rows are documents of their own, side by side; an empty table gives an empty result.
    """
    keep = [id_col] if keep is None else keep
    made = _free(["size", "source_size", "target", "copies", "taken"], keep)
    return _laid(docs, keep, id_col, schedules).select("row.*", *[F.col(c).alias(name) for c, name in made.items()])


def training_order(
    docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", schedules: dict[int, tuple[float, float]] | None = None
) -> DataFrame:
    """A row per copy taken with its position and words, range-partitioned and sorted by position."""
    keep = [id_col] if keep is None else keep
    made = _free(["position", "words"], keep)
    copies = _laid(docs, keep, id_col, schedules).select("row", F.explode("copies").alias("copy")).orderBy("copy.position")
    return copies.select("row.*", *[F.col("copy")[c].alias(name) for c, name in made.items()])


def whole_copies(docs: DataFrame, schedules: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` once for every copy of which at least half of the words are taken.

    Rows are range-partitioned and sorted by the copies' positions.
    """
    laid = _laid(docs, docs.columns, "doc_id", schedules)
    halves = F.filter("copies", lambda c: c["words"] * 2 >= F.col("size"))
    return laid.select("row", F.explode(halves).alias("copy")).orderBy("copy.position").select("row.*")
