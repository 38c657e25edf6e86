"""Near-duplicates by the Jaccard similarity of five-word shingles, beside the links of two bits of simhash.py.

Candidates share one of BANDS keys, each made of ROWS minima of hashed shingles: of pairs at SIMILARITY, one in
10,000 shares none. Every candidate is verified on both whole sets of shingles. Texts of the same words are one
class, compared once.

A key with more than CROWDED classes isn't expanded into pairs. Its classes are compared with its least and
greatest one, which links a crowd of near copies. Only what is linked matters, so a key whose classes are all
in one component is done. The classes of the others are compared across components by a prefix join: shingles
are ordered by how few of these classes hold them, and any two at SIMILARITY share one of their first fifth.
Copies of one text, each altered too much for a link, share most of that fifth. So a pair is only made where
the places of the shared shingle leave enough behind it, and where the classes' odd sketches (a bit for each
bucket of shingles: whether their number is odd) differ in no more bits than their sets may in shingles. Both
are bounds, so no pair at SIMILARITY is lost; pairs that share a shingle are still looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm import simhash
from tidegrid.llm.common import cut, join_counted

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: A key with more classes of texts isn't expanded into pairs.
CROWDED = 32
SKETCH = "class long, fp long, n int, bands array<long>"
#: Rows that are sketched at a time.
ROWS_AT_A_TIME = 128
#: Words of 64 bits of an odd sketch.
ODD = 8
#: Shingles whose minima are taken at a time.
CHUNK = 2_048

_RNG = np.random.default_rng(simhash.SEED)
_A, _B, _MIX = (_RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))


def shingle_hashes(data: bytes) -> np.ndarray:
    """Distinct hashed shingles of a UTF-8 text; a shorter text is one shingle, one without words has none."""
    parts = data.lower().split()
    grams = [b" ".join(parts[i : i + WORDS]) for i in range(max(1, len(parts) - WORDS + 1))] if parts else []
    return np.unique(np.array([xxhash.xxh64_intdigest(g, simhash.SEED) for g in grams], dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[i : i + CHUNK] * _A[:, None] + _B[:, None]).min(axis=1))
    return ((least ^ (least >> np.uint64(31))) * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _sketch(text: str | None) -> tuple[int, int, int, np.ndarray]:
    """(class, fp, n, bands) of a text; class: the hash of its words, n: its shingles."""
    data = (text or "").encode()
    hashes = shingle_hashes(data)
    words = np.uint64(xxhash.xxh64_intdigest(b" ".join(data.lower().split()), simhash.SEED))
    fp = np.uint64(simhash.fingerprint_bytes(data))
    return words.view(np.int64), fp.view(np.int64), len(hashes), band_keys(hashes).view(np.int64)


def _in_slices(make, columns: list[str]):
    """``text`` of some rows at a time replaced by the columns that ``make`` gives for it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS_AT_A_TIME):
                part = batch.iloc[i : i + ROWS_AT_A_TIME]
                made = pd.DataFrame([make(t) for t in part["text"]], part.index, columns)
                yield pd.concat([part.drop(columns="text"), made], axis=1)

    return run


def sketches(docs: DataFrame) -> DataFrame:
    """_row (the row_key), doc_id, no_id, class, fp, n and bands of every row; its shingles aren't kept."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(row_key().alias("_row"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), "text")
    return rows.mapInPandas(_in_slices(_sketch, ["class", "fp", "n", "bands"]), f"_row string, doc_id long, no_id boolean, {SKETCH}")


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 ODD buckets, set if it holds an odd number of ``hashes``; those of two sets differ in no
    more bits than the sets in elements."""
    out = np.zeros(ODD, dtype=np.uint64)
    np.bitwise_xor.at(out, (hashes // np.uint64(64) % np.uint64(ODD)).astype(np.int64), np.uint64(1) << hashes % np.uint64(64))
    return out


def _set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    hashes = shingle_hashes((text or "").encode())
    return hashes.view(np.int64), odd_sketch(hashes).view(np.int64)


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, shingles, odd) of the ``wanted`` classes alone, from the text of the row that stands for each."""
    rows = cut(classes.join(wanted, "class", "left_semi").select("_row", "class"), "shingle-wanted")
    texts = docs.select(row_key().alias("_row"), "text").join(rows, "_row").dropDuplicates(["class"]).select("class", "text")
    shingled = _in_slices(_set, ["shingles", "odd"])
    return cut(texts.mapInPandas(shingled, "class long, shingles array<long>, odd array<long>"), "shingle-sets")


def _sharing(classes: DataFrame) -> DataFrame:
    """(key, class, n, _n, _a, _z): the keys of each class that _n > 1 classes have, and the least and greatest of these."""
    keyed = cut(classes.select("class", "n", F.explode("bands").alias("key")), "shingle-keyed")
    one = F.struct("class", "n")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(one).alias("_a"), F.max(one).alias("_z")).where("_n > 1")
    return cut(join_counted(keyed, cut(sizes, "shingle-keys"), "key", "_n", keyed.count()), "shingle-shared")


def _fitting(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, of pairs (x, y) of structs (class, n) whose sizes allow SIMILARITY."""
    fit = F.least("x.n", "y.n") >= F.lit(SIMILARITY) * F.greatest("x.n", "y.n")
    return pairs.where((F.col("x.class") < F.col("y.class")) & fit).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def _candidates(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: all classes that share an uncrowded key, and those of a crowded one with its least and greatest."""
    few = shared.where(F.col("_n") <= CROWDED).select("key", F.struct("class", "n").alias("x"))
    pairs = few.join(few.withColumnRenamed("x", "y"), "key").select("x", "y")
    ends = shared.where(F.col("_n") > CROWDED).select(F.struct("class", "n").alias("x"), F.explode(F.array("_a", "_z")).alias("y"))
    return _fitting(pairs.unionByName(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))))


def _open(shared: DataFrame, state: DataFrame) -> DataFrame:
    """(class, root): the classes of crowded keys that hold several components."""
    named = state.select(F.col("node").alias("class"), "root")
    rooted = shared.where(F.col("_n") > CROWDED).join(named, "class", "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    rooted = cut(rooted, "shingle-rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a <> _z").select("key")
    return cut(rooted.join(several, "key", "left_semi").select("class", "root").distinct(), "shingle-open")


def _apart(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: candidates in different components. left: (class, root); sets: their shingles and odd sketches.

    Their first common shingle is among the larger one's first fifth and, as it has no more shingles, among the
    smaller one's first ninth; all other common ones come behind it in both.
    """
    held = left.join(sets, "class")
    each = cut(held.select("class", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("token")), "shingle-tokens")
    rarity = each.groupBy("token").agg(F.count(F.lit(1)).alias("_df"), F.min("root").alias("_a"), F.max("root").alias("_z"))
    ranked = join_counted(each, cut(rarity, "shingle-rarity"), "token", "_df", each.count())
    order = Window.partitionBy("class").orderBy("_df", "token")
    prefix = ranked.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= F.col("n") - F.ceil(F.lit(SIMILARITY) * F.col("n")) + 1)
    one = F.struct("class", "n", F.col("_at").alias("at"), "odd")
    met = cut(prefix.where("_a <> _z").join(sets.select("class", "odd"), "class").select("token", "root", one.alias("x")), "shingle-prefix")
    share = SIMILARITY / (1 + SIMILARITY)  # of both sizes; common shingles are so many at least
    small = met.where(F.col("x.at") <= F.col("x.n") - F.ceil(2 * share * F.col("x.n") - 1e-6) + 1)
    large = met.select("token", F.col("root").alias("_r"), F.col("x").alias("y"))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class") < F.col("y.class")))
    need = F.ceil(share * (F.col("x.n") + F.col("y.n")) - 1e-6)
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    differing = sum((simhash.hamming(F.col("x.odd")[i], F.col("y.odd")[i]) for i in range(ODD)), F.lit(0))
    fit = (F.col("x.n") >= F.lit(SIMILARITY) * F.col("y.n")) & (behind >= need) & (differing <= F.col("x.n") + F.col("y.n") - 2 * need)
    pairs = small.join(large, "token").where((F.col("root") != F.col("_r")) & smaller & fit)
    return pairs.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of SIMILARITY or more, by their whole sets of shingles."""
    left, right = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    common = F.size(F.array_intersect("_a", "_b"))
    met = pairs.join(left, "a").join(right, "b")
    return met.where(common >= F.lit(SIMILARITY) * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def linked(docs: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the components of ``edges`` (a, b) and all links at SIMILARITY. classes: _row, class, n, bands."""
    shared = _sharing(classes)
    pairs = cut(_candidates(shared), "shingle-pairs")
    met = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    state = simhash.components(edges.unionByName(_similar(pairs, sets_of(docs, classes, met))))
    left = _open(shared, state)
    if left.isEmpty():
        return state
    sets = sets_of(docs, classes, left.select("class"))
    across = cut(_similar(cut(_apart(left, sets), "shingle-apart"), sets), "shingle-across")
    return simhash.components(state.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(across))


def row_key() -> Column:
    """A digest that tells rows apart by doc_id and text."""
    none = F.col("text").isNull().cast("string")
    return F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), none, F.coalesce("text", F.lit(""))))


def survivors(docs: DataFrame) -> DataFrame:
    """_row: the row_key of the first row, by doc_id, of each component of near-duplicates."""
    rows = cut(sketches(docs), "shingle-rows")
    classes = cut(rows.groupBy("class").agg(F.min("_row").alias("_row"), *[F.first(c).alias(c) for c in ("fp", "n", "bands")]), "shingle-classes")
    prints = cut(classes.groupBy("fp").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("_n")), "shingle-prints")
    named = join_counted(classes.select("class", "fp"), prints, "fp", "_n", classes.count())
    same = named.select(F.col("first").alias("a"), F.col("class").alias("b")).where("a <> b")
    near = cut(simhash.links(prints.select("fp")), "shingle-links")
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"_{end}")), end)
    near = near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    state = linked(docs, classes, same.unionByName(near))
    first = F.min(F.struct("no_id", "doc_id", "_row")).alias("_f")
    per_class = rows.groupBy("class").agg(first)
    named = per_class.join(state.withColumnRenamed("node", "class"), "class", "left")
    return named.groupBy(F.coalesce("root", "class").alias("_r")).agg(F.min("_f").alias("_f")).select("_f._row")
