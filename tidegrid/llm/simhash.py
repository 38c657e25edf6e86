"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Documents are reduced to distinct fingerprints first, so exact and near copies with one fingerprint cost
one row. Each fingerprint gets a table of its Hamming distances to reference fingerprints (pivots):

- Families. The 64 bits are dealt to five families; the references of a family differ from a common reference
  in bits of the family alone, so how much farther they are is a coordinate that changes only if such a bit
  does. Two fingerprints that differ in at most two bits have equal coordinates in three families at least:
  those of three families, in each of the ten choices, are a cell, and candidates are the pairs of a cell.
- Pivots over all bits. A pair is discarded if its distances to any of them differ by more than the threshold
  (triangle inequality).

The Hamming distance of the survivors is computed. A cell with more than CROWDED fingerprints isn't expanded
into pairs but split by the coordinates of five other families, and so on, until none is left: what holds for
the first families holds for all. (Cells of a width of three of single random pivots wouldn't do: to find all
neighbours a fingerprint goes to 2.3 cells for each pivot, and each halves the candidates of one cell only.)
Components are found by contracting them, in rounds that grow with the logarithm of their size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidegrid.llm.common import cut, join_counted

SEED = 42
BITS = 64
MAX_DISTANCE = 2
#: Families of references, in which all but MAX_DISTANCE agree in every link, and references of each.
FAMILIES, REFERENCES = 5, 8
#: Pivots over all bits, that is, coordinates by which a pair of candidates can be discarded.
WHOLE_PIVOTS = 16
#: A cell with more distinct fingerprints is split by further families.
CROWDED = 32
#: Shingles hashed at a time, so that a long text needs no more memory.
CHUNK = 100_000


def fingerprint_bytes(data: bytes, words: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    parts = data.lower().split()  # of bytes: A-Z, and white space \x20\x09-\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    of, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, CHUNK):
        values = np.array([of(joined[a:b], SEED) for a, b in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])], dtype="<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs; null texts get 0."""
    values = [fingerprint_bytes(x.encode()) if x else 0 for x in texts]
    return pd.Series(np.array(values, dtype=np.uint64).view(np.int64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def whole_pivots() -> list[int]:
    rng = np.random.default_rng(SEED)
    return [int(x) for x in rng.integers(0, 1 << 63, WHOLE_PIVOTS, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, WHOLE_PIVOTS, dtype=np.uint64)]


def families(level: int) -> tuple[int, list[list[int]]]:
    """(a reference, the references of each family, which differ from it in the family's bits alone)."""
    rng = np.random.default_rng((SEED, level))
    dealt = rng.permutation(BITS) % FAMILIES
    common = sum(1 << b for b in range(BITS) if rng.random() < 0.5)
    out = []
    for g in range(FAMILIES):
        bits = [int(b) for b in np.flatnonzero(dealt == g)]
        out.append([common ^ sum(1 << b for b in bits if rng.random() < 0.5) for _ in range(REFERENCES)])
    return common, out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance_table(fps: DataFrame) -> DataFrame:
    """fp with ``d``: its distances to the pivots over all bits, a byte each."""
    return fps.withColumn("d", F.array(*[hamming(F.col("fp"), F.lit(_signed(p))).cast("byte") for p in whole_pivots()]))


def cells(rows: DataFrame, level: int) -> DataFrame:
    """(cell, fp, d): ``rows`` (cell, fp, d) once in each cell of the level that lies in their cell."""
    common, refs = families(level)
    to_common = hamming(F.col("fp"), F.lit(_signed(common)))
    places = [F.xxhash64(*[hamming(F.col("fp"), F.lit(_signed(r))) - to_common for r in of]).alias(f"f{g}") for g, of in enumerate(refs)]
    placed = rows.select("cell", "fp", "d", *places)
    chosen = combinations(range(FAMILIES), FAMILIES - MAX_DISTANCE)
    keys = [F.xxhash64("cell", F.lit(i), *[f"f{g}" for g in some]) for i, some in enumerate(chosen)]
    return placed.select(F.explode(F.array(*keys)).alias("cell"), "fp", "d")


def candidates(fps: DataFrame) -> DataFrame:
    """(a, b, apart), a < b, with repeats: pairs of a cell; apart: their largest difference to any pivot.

    fps: one column ``fp`` of distinct longs.
    """
    rows, out, level = distance_table(fps).withColumn("cell", F.lit(0).cast("long")), None, 0
    while True:
        keyed = cut(cells(rows, level), "simhash-cells")
        sizes = cut(keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "simhash-sizes")
        shared = cut(join_counted(keyed, sizes, "cell", "_n", keyed.count()), "simhash-shared")
        few = shared.where(F.col("_n") <= CROWDED).drop("_n")
        other = few.select("cell", F.col("fp").alias("b"), F.col("d").alias("e"))
        apart = F.coalesce(F.array_max(F.zip_with("d", "e", lambda x, y: F.abs(x - y))), F.lit(0))
        pairs = few.withColumnRenamed("fp", "a").join(other, "cell").where("a < b").select("a", "b", apart.alias("apart"))
        out = pairs if out is None else out.unionByName(pairs)
        rows, level = shared.where(F.col("_n") > CROWDED).drop("_n"), level + 1
        if rows.isEmpty():
            return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints within MAX_DISTANCE. fps: one column ``fp`` of longs."""
    near = (F.col("apart") <= MAX_DISTANCE) & (hamming(F.col("a"), F.col("b")) <= MAX_DISTANCE)
    return candidates(fps).where(near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of ``edges`` (a, b).

    In each round every node points to the one that hashes least of itself and its neighbours, and edges are
    drawn between the nodes pointed to. The hash is another in each round, so that about half of the nodes are
    left, whatever the shape; the one that hashes most never is, so this ends when no edge is left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct(), "simhash-edges")
    steps = []
    while not both.isEmpty():
        rank = lambda c, i=len(steps): F.struct(F.xxhash64(c, F.lit(i)).alias("h"), F.col(c).alias("to"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("_b"))
        step = cut(least.select(F.col("a").alias("node"), F.least("_b", rank("a"))["to"].alias("to")), "simhash-steps")
        steps.append(step)
        for end in ("a", "b"):
            both = both.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        both = cut(both.where("a <> b").select("a", "b").distinct(), "simhash-edges")
    # Backwards: where each node's last is from the next round on. Tables halve from round to round.
    last = steps.pop() if steps else both.select(F.col("a").alias("node"), F.col("b").alias("to"))
    for step in reversed(steps):
        further = last.select(F.col("node").alias("to"), F.col("to").alias("_last"))
        last = cut(step.join(further, "to", "left").select("node", F.coalesce("_last", "to").alias("to")), "simhash-last")
    roots = last.groupBy("to").agg(F.min("node").alias("root"))
    return cut(last.join(roots, "to").select("node", "root"), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (least doc_id reachable over links).

    One row per row of ``docs``. Null and wordless texts have fingerprint zero and link like any other.
    Rows with a null doc_id take part; a component that has no other has a null component_id. Ties and
    repeated rows fall into one component; texts of any length are read whole, some shingles at a time; an
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint("text").alias("fp")), "simhash-docs")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")), "simhash-classes")
    state = components(cut(links(classes.select("fp")), "simhash-links"))
    rooted = classes.join(state.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "_n", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id", "_n"), "simhash-named")
    return join_counted(prints, named, "fp", "_n", prints.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
