"""Nearest neighbours by an adaptive dimension scan over probed lists.

Vectors are dealt to the lists of the nearest of some centroids. A query is first compared with its own list,
which bounds its k-th best distance, and then with the lists of the centroids nearest to it; a list whose
farthest vector leaves no room within the bound is passed over. Within a list, the rotated vectors are read in
blocks of columns. The share of a squared distance that lies in the first d of D columns of a random rotation
has a Beta distribution, with mean d / D; a candidate is abandoned as soon as its share is so large that its
distance would be within the bound in one case of some hundreds. The bound is tightened from block to block.
Survivors get their exact cosine from the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import cut

#: About so many vectors, chosen by hash, are what centroids are fitted on; and the most lists.
SAMPLE, MAX_LISTS = 20_000, 4_096
#: A query probes so many lists that they hold this share of the true neighbours within the sample, as
#: measured for some of its vectors; and lists with so many vectors at least, if there are.
PROBED_RECALL, MEASURED, MIN_CANDIDATES = 0.97, 400, 200
#: Columns read at a time, and how many standard deviations of its share a candidate may be over the bound.
BLOCK, DEVIATIONS = 16, 3.0
#: Pairs of a block that are computed for all candidates at once, while so large a share of them is left.
DENSE = 0.2
#: The most vectors and queries of a list that one task holds at a time, on average; a list with so many times
#: the vectors of an average one is dealt to several tasks too; and pairs that are compared at a time.
VECTORS_PER_GROUP, QUERIES_PER_GROUP, UNEVEN, PAIRS = 8_192, 1_024, 2, 1 << 20
#: Added to squared distances of unit vectors, against rounding of their single precision parts.
SLACK = 1e-5

SEED = 42
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dims, unit length
    rotation: np.ndarray  # dims x dims, orthogonal
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(rid, vec_id, v) of the rows whose vector is finite and not zero; rid is the row's own."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), finite.alias("_ok"))
    some = F.exists("v", lambda x: x != 0)
    return ok.where(F.col("_ok") & some).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v")


def _probes(x: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """How many lists, nearest first, hold PROBED_RECALL of the k nearest others of some rows of ``x``."""
    lists = np.argmax(x @ centroids.T, axis=1)
    ranks = []
    for i in range(min(MEASURED, len(x))):
        near = x @ x[i]
        near[i] = -np.inf
        found = lists[np.argsort(-near, kind="stable")[:k]]
        place = np.empty(len(centroids), np.int64)
        place[np.argsort(-(centroids @ x[i]), kind="stable")] = np.arange(len(centroids))
        ranks.extend(place[found])
    return int(np.quantile(ranks, PROBED_RECALL)) + 1


def fit(vectors: DataFrame, n: int, dims: int, k: int) -> Index:
    """Centroids by k-means on a sample of about SAMPLE vectors, a random rotation, and how many lists to probe."""
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    n_lists = max(1, min(MAX_LISTS, isqrt(n) // 2))
    part = int((1 << 30) * min(1.0, SAMPLE / n))
    rows = vectors.where(F.pmod(F.xxhash64("rid"), F.lit(1 << 30)) < part).select("rid", "v").toArrow().sort_by("rid")
    x = _unit(rows["v"].combine_chunks().flatten().to_numpy().reshape(len(rows), dims))
    centroids = x[rng.permutation(len(x))[:n_lists]].copy()
    for _ in range(8):
        near = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids[moved] = _unit(sums[moved])
    return Index(centroids, rotation, min(len(centroids), _probes(x, centroids, k)))


def _array(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def _firsts(groups: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their group; equal ``groups`` stand side by side."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    at = np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))
    return at < k


def survivors(tx: np.ndarray, tq: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of tq, rows of tx) of the pairs that no test abandons.

    tx, tq: rotated unit vectors, single precision. own: pairs that are no candidates. bound: the squared
    distance of each query's k-th best so far, infinite if there are fewer.
    """
    dims = tx.shape[1]
    bound = bound.copy()
    part = np.zeros(own.shape, np.float32)
    alive = ~own
    qi = xi = left = None  # once few pairs are left: their rows, and their distances so far
    for at in range(0, dims, BLOCK):
        end = min(dims, at + BLOCK)
        a, b = tq[:, at:end], tx[:, at:end]
        if qi is None:
            part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
            if at == 0 or end == dims:  # exact distances of the most promising bound the k-th best
                part[own] = np.inf
                if part.shape[1] > k:
                    few = np.argpartition(part, k - 1, axis=1)[:, :k]
                    exact = ((tx[few] - tq[:, None, :]) ** 2).sum(axis=2)
                    full = np.isfinite(np.take_along_axis(part, few, 1)).all(axis=1)
                    bound = np.minimum(bound, np.where(full, exact.max(axis=1), np.inf))
        else:
            gap = a[qi] - b[xi]
            left = left + (gap * gap).sum(axis=1)
            order = np.lexsort((left, qi))
            qi, xi, left = qi[order], xi[order], left[order]
            first = _firsts(qi, k)
            held = np.bincount(qi[first], minlength=len(bound))
            worst = np.zeros(len(bound), np.float32)
            np.maximum.at(worst, qi[first], ((tx[xi[first]] - tq[qi[first]]) ** 2).sum(axis=1))
            bound = np.where(held >= k, np.minimum(bound, worst), bound)
        share = end / dims
        limit = bound * min(1.0, share + DEVIATIONS * (2 * share * (1 - share) / (dims + 2)) ** 0.5) + SLACK
        if qi is None:
            alive &= part <= limit[:, None]
            if alive.sum() <= DENSE * alive.size:
                qi, xi = np.nonzero(alive)
                left = part[qi, xi]
        else:
            keep = left <= limit[qi]
            qi, xi, left = qi[keep], xi[keep], left[keep]
        if qi is not None and not len(qi):
            break
    return np.nonzero(alive) if qi is None else (qi, xi)


def _compare(vs: pd.DataFrame, qs: pd.DataFrame, rotation: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a part of a list for each query: (qid, query_id, vec_id, no_id, score)."""
    out = []
    if len(vs) and len(qs):
        x, q = _array(vs["v"]), _array(qs["q"])
        rids, ids, none = vs["rid"].to_numpy(), vs["vec_id"].to_numpy(), vs["no_id"].to_numpy()
        qids, query_ids, floor = qs["qid"].to_numpy(), qs["query_id"].to_numpy(), qs["floor"].to_numpy(float)
        norms, q_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        tx = ((x / norms[:, None]) @ rotation).astype(np.float32)
        tq = ((q / q_norms[:, None]) @ rotation).astype(np.float32)
        bound = np.where(np.isnan(floor), np.inf, 2 - 2 * floor)
        step = max(1, PAIRS // len(x))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            qi, xi = survivors(tx, tq[some], qids[some, None] == rids[None, :], bound[some], k)
            qi = qi + at
            score = np.zeros(len(qi))
            for i in range(0, len(qi), PAIRS // 16):
                a, b = qi[i : i + PAIRS // 16], xi[i : i + PAIRS // 16]
                score[i : i + PAIRS // 16] = (x[b] * q[a]).sum(axis=1) / (norms[b] * q_norms[a])
            order = np.lexsort((ids[xi], none[xi], -score, qi))
            order = order[_firsts(qi[order], k)] if len(order) else order
            a, b = qi[order], xi[order]
            out.append(pd.DataFrame({"qid": qids[a], "query_id": query_ids[a], "vec_id": ids[b], "no_id": none[b], "score": score[order]}))
    return pd.concat(out) if out else pd.DataFrame({"qid": [], "query_id": [], "vec_id": [], "no_id": [], "score": []}).astype({"no_id": bool})


FOUND = "qid long, query_id long, vec_id long, no_id boolean, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest others by cosine.

    ``is_query`` is over vec_id. Every row but the query's own is a candidate, rows that repeat its id or its
    vector too, and rows without an id, whose vec_id is null; each row that ``is_query`` names is a query of
    its own, so a repeated id has as many times k rows. Ties go to the smaller vec_id, null last. Vectors that
    are null, zero, or hold null or non-finite components take no part, nor do those of another length than
    the most common (of these, the shortest). A query has fewer than k rows if there are fewer others. Very
    long vectors cost memory in proportion. An empty table gives an empty result; columns other than the id
    and ``embedding`` are ignored, whatever their names.
    """
    spark: SparkSession = vectors.sparkSession
    whole = cut(usable(vectors, id_col), "ann-vectors")
    sizes = whole.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n = sizes["d"], sizes["n"]
    data = whole.where(F.size("v") == dims)
    index = fit(data, n, dims, k)
    shared = spark.sparkContext.broadcast(index)  # MAX_LISTS centroids at most

    def assign(batches):
        of = shared.value
        for batch in batches:
            cosines = _unit(_array(batch["v"])) @ of.centroids.T
            near = np.argmax(cosines, axis=1)
            yield batch.assign(list=near.astype(np.int32), angle=np.arccos(np.clip(cosines.max(axis=1), -1, 1)))

    kept = data.select("rid", F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), F.col("vec_id").isNull().alias("no_id"), "v")
    dealt = cut(kept.mapInPandas(assign, "rid long, vec_id long, no_id boolean, v array<double>, list int, angle double"), "ann-lists")
    # A row per list: its size and the angle of its farthest vector.
    per_list = dealt.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")).collect()
    in_list, far = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for r in per_list:
        in_list[r["list"]], far[r["list"]] = r["n"], r["far"]

    def met(asked: DataFrame) -> DataFrame:
        """The best of every list for the queries sent to it; asked: (qid, query_id, q, floor, list)."""
        wanted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        most = min(VECTORS_PER_GROUP, max(1, UNEVEN * n // len(in_list)))
        parts = [(i, max(1, -(-int(in_list[i]) // most)), max(1, -(-m // QUERIES_PER_GROUP))) for i, m in wanted.items()]
        splits = F.broadcast(spark.createDataFrame(parts, "list int, vs int, qs int"))
        # A crowded list is scanned in parts: every part of its vectors meets every part of its queries.
        mine = F.pmod(F.xxhash64("rid"), F.col("vs")).cast("int")
        left = dealt.join(splits, "list").select("list", mine.alias("vp"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qp"), "rid", "vec_id", "no_id", "v")
        theirs = F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int")
        right = asked.join(splits, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("vp"), theirs.alias("qp"), "qid", "query_id", "q", "floor")
        keys = ["list", "vp", "qp"]
        best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda vs, qs: _compare(vs, qs, shared.value.rotation, k), FOUND)
        return cut(best, "ann-found")

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "no_id", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = dealt.where(~F.col("no_id")).where(is_query).select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "list")
    at_home = met(cut(queries.withColumn("floor", F.lit(None).cast("double")), "ann-home"))
    floors = ranked(at_home).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    def probe(batches):
        of = shared.value
        for batch in batches:
            angles = np.arccos(np.clip(_unit(_array(batch["q"])) @ of.centroids.T, -1, 1))
            order = np.argsort(angles, axis=1, kind="stable")
            enough = np.cumsum(in_list[order], axis=1) - in_list[order] < MIN_CANDIDATES
            take = enough | (np.arange(len(in_list)) < of.probes)
            floor = batch["floor"].to_numpy(float)
            reach = np.where(np.isnan(floor), np.inf, np.arccos(np.clip(floor, -1, 1)))  # the angle of the k-th best
            near = angles - far <= reach[:, None] + 1e-6
            lists = [[int(x) for x in row[t] if in_list[x] and ok[x] and x != home] for row, t, ok, home in zip(order, take, near, batch["list"])]
            yield pd.DataFrame({"qid": batch["qid"], "query_id": batch["query_id"], "q": batch["q"], "floor": floor, "lists": lists})

    asked = queries.join(floors, "qid", "left").mapInPandas(probe, "qid long, query_id long, q array<double>, floor double, lists array<int>")
    # Without a bound the floor came back as NaN.
    asked = asked.select("qid", "query_id", "q", F.nanvl("floor", F.lit(None).cast("double")).alias("floor"), F.explode("lists").alias("list"))
    found = at_home.unionByName(met(cut(asked, "ann-probes")))
    vec_id = F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id")
    return ranked(found).select("query_id", "rank", vec_id, "score")
