"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

Every benchmark item is cut into windows of consecutive words. A document holds a window only if it holds
all of the window's shingles (two neighbouring words), so that a prefix of one is necessary and enough:
shingles are ordered by how often they occur in the documents, and the rarest of each window is its prefix.
Document shingles are joined with the prefixes, candidates that would start before the text or end behind it
are dropped, and the rest are compared word by word with the window at that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import cut

#: Words of a window; shorter items are one window.
WINDOW = 10
#: Up to so many windows are broadcast (about 60 MB); more are joined by a shuffle of the shingles.
BROADCAST_WINDOWS = 200_000
#: In a shuffle, shingles with one in so many of all words at least are dealt to SALTS tasks.
HOT_SHARE, SALTS = 1_000, 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words, before lower-casing: ASCII other than letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """The words in their original case; null: none."""
    return F.coalesce(F.array_remove(F.split(text, BREAKS), ""), F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, words): each window of each item, joined by spaces."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), raw_words(ascii_lower(F.col("text"))).alias("_w")
    ).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - WINDOW + 1, F.lit(1)))
    cuts = items.select("item_id", "_w", F.explode(starts).alias("_at"))
    words = F.slice("_w", F.col("_at"), F.least(F.lit(WINDOW), F.size("_w")))
    return cuts.select("item_id", words.alias("words")).select("item_id", F.array_join("words", " ").alias("text"), "words").distinct()


def _doc_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("_h"), raw_words(F.col("text")).alias("_w"))


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_keys``: the hashes of the shingles of ``_w``, and behind them of its words.

    For hashing, words are lower-cased by all of Unicode, which merges no fewer.
    """
    low = rows.withColumn("_l", F.transform("_w", lambda w: F.lower(w)))
    n = F.greatest(F.size("_l") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_l", F.lit(1), n), F.slice("_l", F.lit(2), n), lambda x, y: F.xxhash64(x, y))
    alone = F.transform("_l", lambda x: F.xxhash64(x))
    return low.withColumn("_keys", F.concat(pairs, alone)).drop("_l")


def _exploded(docs: DataFrame, singles: bool) -> DataFrame:
    """A row per document shingle, and word if ``singles``: doc_id, _h, _w, _key (as of ``_keyed``) and its place _at."""
    rows = _doc_words(docs).select("doc_id", "_h", "_w", F.posexplode("_w").alias("_at", "_word"))
    following = F.get("_w", F.col("_at") + 1)
    pair = F.when(following.isNotNull(), F.xxhash64(F.lower("_word"), F.lower(following)))
    key = F.explode(F.array(pair, F.xxhash64(F.lower("_word")))) if singles else pair
    return rows.select("doc_id", "_h", "_w", "_at", key.alias("_key")).where(F.col("_key").isNotNull())


def prefixes(docs: DataFrame, wins: DataFrame, singles: bool) -> DataFrame:
    """Each window (text, n words) with its rarest shingle over all documents: _key, and its place _off."""
    each = wins.select("text", F.size("words").alias("n"), F.col("words").alias("_w")).dropDuplicates(["text"])
    each = _keyed(each).drop("_w").select("text", "n", F.posexplode("_keys").alias("_off", "_key"))
    each = cut(each.where((F.col("n") == 1) | (F.col("_off") < F.col("n") - 1)), "decon-shingles")
    vocabulary = each.select("_key").distinct()
    met = _exploded(docs, singles).select("_key")
    if vocabulary.count() <= BROADCAST_WINDOWS:
        met = met.join(F.broadcast(vocabulary), "_key", "left_semi")
    counts = met.groupBy("_key").agg(F.count(F.lit(1)).alias("_df"))
    ranked = each.join(counts, "_key", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    best = F.min(F.struct("_df", "_off", "_key")).alias("_best")
    return ranked.groupBy("text", "n").agg(best).select("text", "n", F.col("_best._key").alias("_key"), F.col("_best._off").alias("_off"))


def _met_by_shuffle(docs: DataFrame, index: DataFrame, singles: bool) -> DataFrame:
    """The rows of ``_exploded`` joined with ``index``, without their words; a hot shingle is dealt to SALTS tasks."""
    rows = _exploded(docs, singles).select("doc_id", "_h", F.size("_w").alias("_n"), "_at", "_key")
    least = (docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // (8 * HOT_SHARE) + 1  # 8 characters a word
    hot = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") >= least).select("_key", F.lit(True).alias("_hot"))
    hot = F.broadcast(cut(hot, "decon-hot"))  # some thousand at most
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id", "_h", "_at"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, "_key", "left").withColumn("_salt", salt).drop("_hot")
    right = index.join(hot, "_key", "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return left.join(right, ["_key", "_salt"])


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _h, start, n, text) of every window found, and the windows (item_id, text)."""
    wins = cut(windows(benchmark), "decon-windows")
    singles = not wins.where(F.size("words") == 1).isEmpty()
    index = cut(prefixes(docs, wins, singles), "decon-prefixes")
    start = F.col("_at") - F.col("_off")
    same = ascii_lower(F.array_join(F.slice("_w", start + 1, F.col("n")), " ")) == F.col("text")
    if index.count() <= BROADCAST_WINDOWS:
        bounds = (start >= 0) & (start + F.col("n") <= F.size("_w"))
        found = _exploded(docs, singles).join(F.broadcast(index), "_key").where(bounds & same)
    else:
        rows = _met_by_shuffle(docs, index, singles)
        rows = rows.where((start >= 0) & (start + F.col("n") <= F.col("_n"))).drop("_n", "_key", "_salt")
        texts = _doc_words(docs).dropDuplicates(["doc_id", "_h"]).withColumnRenamed("doc_id", "_id").withColumnRenamed("_h", "_h3")
        found = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h3"))).where(same)
    return cut(found.select("doc_id", "_h", start.alias("start"), "n", "text").distinct(), "decon-found"), wins.select("item_id", "text").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a window found), items (sorted ids), contaminated.

    Words: runs of 0-9, a-z (A-Z are lower-cased) and anything beyond ASCII. Null texts have no words; items
    without words are ignored, an item with a null id is called 'null', and items of one id count once.
    Texts of any length are read whole. Repeated rows get equal results. With an empty benchmark nothing is
    hit; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    found, wins = occurrences(docs, benchmark)
    end = F.col("start") + F.col("n")
    earlier = Window.partitionBy("doc_id", "_h").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "_h", "start", "n").distinct()
    fresh = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))
    hit = spans.withColumn("_new", F.greatest(fresh, F.lit(0))).groupBy("doc_id", "_h").agg(F.sum("_new").alias("n_hit"))
    items = found.select("doc_id", "_h", "text").distinct().join(wins, "text").groupBy("doc_id", "_h")
    items = items.agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = hit.select(F.col("doc_id").alias("_i1"), F.col("_h").alias("_h1"), "n_hit")
    items = items.select(F.col("doc_id").alias("_i2"), F.col("_h").alias("_h2"), "items")
    both = cut(hit.join(items, F.col("_i1").eqNullSafe(F.col("_i2")) & (F.col("_h1") == F.col("_h2"))).drop("_i2", "_h2"), "decon-hits")
    plain = _doc_words(docs).select("doc_id", "_h", F.size("_w").cast("long").alias("n_words"))
    out = plain.join(both, F.col("doc_id").eqNullSafe(F.col("_i1")) & (F.col("_h") == F.col("_h1")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated")
    )
