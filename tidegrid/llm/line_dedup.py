"""Line dedup with two Bloom filters.

Each scan task hashes its documents' lines and sends the distinct hashes to the owners of their prefixes. An
owner keeps a Bloom filter of the hashes of its prefix seen once; what it sees again is a suspected repeat and
goes into the filter of lines seen twice. As prefixes get more numerous with the lines, no filter of lines seen
once fills up, whatever the size; the other holds repeats alone. Lines that it holds are shuffled, by their
exact text, to confirm that several documents hold them and to choose the first. Only documents with such lines
are shuffled to be cut; the others leave the scan as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import cut, join_counted

#: Keys of fewer code points are never dropped.
MIN_CHARS = 10
#: Bits of a filter for each line, and the lines of a prefix, at least on average and at most (64 MB).
BITS_PER_LINE, PREFIX_LINES, MIN_LOG_PREFIXES = 16, 1 << 25, 6
#: Bits of the filter of repeats: at least, and at most (128 MB; beyond, more lines are suspected).
MIN_LOG_BITS, MAX_LOG_BITS = 19, 30
#: Bytes of that filter that are merged at a time.
SEGMENT = 1 << 16
#: Hashes that a scan task holds before it sends them, and rows that are worked on at a time.
HELD, ROWS = 1 << 18, 256

WHITE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(WHITE) for x in (text or "").encode().lower().split(b"\n")]


def long_enough(key: bytes) -> bool:
    n = len(key)
    return n >= 4 * MIN_CHARS or (n >= MIN_CHARS and len(key.decode()) >= MIN_CHARS)


class Bloom:
    """A bit set with two bits for each 64-bit hash; ``add`` and ``has`` take arrays."""

    def __init__(self, log_bits: int, data: bytes | None = None):
        self.mask = np.uint64((1 << log_bits) - 1)
        size = max(1, (1 << log_bits) // 8)
        self.bits = np.zeros(size, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def _places(self, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        at = [hashes & self.mask, (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & self.mask]
        return [((x >> np.uint64(3)).astype(np.int64), np.left_shift(1, (x & np.uint64(7)).astype(np.uint8)).astype(np.uint8)) for x in at]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        (a, x), (b, y) = self._places(hashes)
        return ((self.bits[a] & x) != 0) & ((self.bits[b] & y) != 0)

    def add(self, hashes: np.ndarray) -> None:
        for a, x in self._places(hashes):
            np.bitwise_or.at(self.bits, a, x)


def _hashes(log_prefixes: int):
    """Rows (prefix, once, twice): packed hashes of lines that one, or more, of a batch of documents hold."""

    def parts(each: list[int]) -> pd.DataFrame:
        values, counts = np.unique(np.array(each, dtype=np.uint64), return_counts=True)
        prefix = (values >> np.uint64(64 - log_prefixes)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(values) else []
        rows = []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            more = counts[a:b] > 1
            rows.append((int(prefix[a]), values[a:b][~more].tobytes(), values[a:b][more].tobytes()))
        return pd.DataFrame(rows, columns=["prefix", "once", "twice"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[int] = []
        for batch in batches:
            for text in batch["text"]:
                held += [xxhash.xxh64_intdigest(k) for k in set(line_keys(text)) if long_enough(k)]
                if len(held) >= HELD:
                    yield parts(held)
                    held = []
        yield parts(held)

    return scan


def _repeats(log_bits: int):
    """Rows (prefix, hashes): those of a prefix that come more than once, and some few of those that don't."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Bloom] = {}
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for prefix, *packed in batch[["prefix", "once", "twice"]].itertuples(index=False):
                once, twice = (np.frombuffer(x, np.uint64) for x in packed)
                of = seen.setdefault(prefix, Bloom(log_bits))
                again = np.concatenate([once[of.has(once)], twice])
                of.add(once)
                of.add(twice)
                if len(again):
                    found[prefix] = np.union1d(found.get(prefix, again), again)
        for prefix, hashes in found.items():
            yield pd.DataFrame({"prefix": [prefix], "hashes": [hashes.tobytes()], "n": [len(hashes)]})

    return merge


def _fill(log_bits: int):
    """The segments of a filter of the hashes that a task has."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Bloom(log_bits)
        for batch in batches:
            for packed in batch["hashes"]:
                of.add(np.frombuffer(packed, np.uint64))
        for at in range(0, len(of.bits), SEGMENT):
            part = of.bits[at : at + SEGMENT]
            if part.any():
                yield pd.DataFrame({"seg": [at // SEGMENT], "bits": [zlib.compress(part.tobytes(), 1)]})

    return fill


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One filter of several, segment by segment; memory: the partition's share of one."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for seg, bits in batch[["seg", "bits"]].itertuples(index=False):
            part = np.frombuffer(zlib.decompress(bits), np.uint8)
            held[seg] = held[seg] | part if seg in held else part
    for seg, part in held.items():
        yield pd.DataFrame({"seg": [seg], "bits": [zlib.compress(part.tobytes(), 1)]})


def twice_filter(docs: DataFrame) -> tuple[int, bytes]:
    """(log2 of its bits, the filter) of line hashes that several documents may hold."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"))) + 1).alias("n")).first()["n"] or 0
    log_prefixes = max(MIN_LOG_PREFIXES, (int(lines) // PREFIX_LINES).bit_length())
    per_prefix = max(MIN_LOG_BITS - MIN_LOG_PREFIXES, (BITS_PER_LINE * int(lines) >> log_prefixes).bit_length())
    parts = docs.select("text").mapInPandas(_hashes(log_prefixes), "prefix long, once binary, twice binary")
    repeats = cut(parts.repartition("prefix").mapInPandas(_repeats(per_prefix), "prefix long, hashes binary, n long"), "line-hashes")
    n = repeats.agg(F.sum("n").alias("n")).first()["n"] or 0
    log_bits = min(MAX_LOG_BITS, max(MIN_LOG_BITS, (BITS_PER_LINE * int(n)).bit_length()))
    filled = repeats.select("hashes").mapInPandas(_fill(log_bits), "seg long, bits binary")
    bits = bytearray((1 << log_bits) // 8)
    for r in filled.repartition("seg").mapInPandas(_merge, "seg long, bits binary").toLocalIterator():  # of bounded size
        data = zlib.decompress(r["bits"])
        bits[r["seg"] * SEGMENT : r["seg"] * SEGMENT + len(data)] = data
    return log_bits, bytes(bits)


def _suspected(seen: Bloom, texts: list[str | None]) -> list[list[tuple[bytes, list[int]]]]:
    """For each text its keys that the filter holds, with the places of their lines."""
    owner: list[int] = []
    keys: list[bytes] = []
    places: list[list[int]] = []
    for j, text in enumerate(texts):
        at: dict[bytes, list[int]] = {}
        for n, k in enumerate(line_keys(text)):
            at.setdefault(k, []).append(n)
        for k, where in at.items():
            if long_enough(k):
                owner.append(j)
                keys.append(k)
                places.append(where)
    out: list[list[tuple[bytes, list[int]]]] = [[] for _ in texts]
    for x in np.flatnonzero(seen.has(np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64))):
        out[owner[x]].append((keys[x], places[x]))
    return out


def _batched(shared, log_bits: int, make):
    """``make`` of ROWS rows at a time and what is suspected in each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Bloom(log_bits, shared.value)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                made = make(part, _suspected(seen, part["text"].tolist()))
                if len(made):
                    yield made

    return run


def _suspects(part: pd.DataFrame, found: list) -> pd.DataFrame:
    at = [j for j, f in enumerate(found) for _ in f]
    rows = part.iloc[at][["doc_id", "no_id", "h"]]
    return rows.assign(key=[k.decode() for f in found for k, _ in f], lines=pd.Series([p for f in found for _, p in f], rows.index, object))


def _untouched(part: pd.DataFrame, found: list) -> pd.DataFrame:
    rows = part[[not f for f in found]]
    kept = rows["text"].fillna("")
    return rows[["doc_id", "no_id"]].assign(kept=kept, n_lines=kept.str.count("\n") + 1, n_dropped=0)


def _touched(part: pd.DataFrame, found: list) -> pd.DataFrame:
    return part[[bool(f) for f in found]]


def _drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.iloc[i : i + ROWS]
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(part["text"], part["drops"]):
                lines = (text or "").split("\n")
                gone = set() if drops is None else set(drops)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                kept.append("\n".join([x for j, x in enumerate(lines) if j not in gone]) if gone else text or "")
            yield part[["doc_id", "no_id"]].assign(kept=kept, n_lines=n_lines, n_dropped=n_dropped)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id, kept (its text without the lines dropped), n_lines, n_dropped.

    A key (the line stripped of ASCII white space, A-Z lower-cased) of MIN_CHARS code points that several
    documents hold stays only in the one with the smallest doc_id, all its lines there included. Null and
    empty texts are one empty line; texts of any length are read whole. A null doc_id counts as the largest;
    rows that repeat a doc_id are one document when lines are compared, and each keeps its own text. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.xxhash64("text").alias("h"), "text")
    log_bits, bits = twice_filter(rows)
    shared = spark.sparkContext.broadcast(bits)
    ids, result = "doc_id long, no_id boolean", "kept string, n_lines long, n_dropped long"
    found = cut(rows.mapInPandas(_batched(shared, log_bits, _suspects), f"{ids}, h long, key string, lines array<int>"), "line-suspects")
    who = F.struct("no_id", "doc_id")
    held = found.groupBy("key").agg(F.min(who).alias("first"), F.max(who).alias("_last"), F.count(F.lit(1)).alias("_n"))
    repeats = cut(held.where("first < _last").drop("_last"), "line-repeats")
    met = join_counted(found, repeats, "key", "_n", found.count())
    drops = met.where(who > F.col("first")).select("doc_id", "no_id", "h", "lines").distinct()
    drops = drops.groupBy("doc_id", "no_id", "h").agg(F.flatten(F.collect_list("lines")).alias("drops"))
    touched = rows.mapInPandas(_batched(shared, log_bits, _touched), f"{ids}, h long, text string")
    marked = touched.join(drops, ["doc_id", "no_id", "h"], "left").select("doc_id", "no_id", "text", "drops")
    out = marked.mapInPandas(_drop, f"{ids}, {result}")
    out = out.unionByName(rows.mapInPandas(_batched(shared, log_bits, _untouched), f"{ids}, {result}"))
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "kept", "n_lines", "n_dropped")
