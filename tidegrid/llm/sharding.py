"""Sharding by balanced label propagation.

Documents are linked through keys: all that share a key (by default their exact text) are neighbours of
that key's hub, so a group of any size costs one row per member and never a pair. Every linked document
starts in a hashed shard. In each round the hubs count their members per shard, every member proposes to
move where most of its neighbours are, and the proposals are granted under quotas that keep each shard
within its capacity. Unlinked documents, which no move can cut, then fill the shards up exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import cut, join_counted, number_rows

#: Classes by which the proposals between two shards are granted; groups stay whole but for the last class.
LEVELS = 1024


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _grant(loads: list[int], wanted: dict[tuple[int, int], int], capacity: int) -> dict[tuple[int, int], int]:
    """How many of the moves wanted between each two shards keep all loads within the capacity.

    Plain arithmetic on one number for each pair of shards: what comes into a shard is scaled to its room, which
    is the less the less goes out of others, until nothing changes.
    """
    n = len(loads)
    allowed = np.zeros((n, n))
    for (a, b), v in wanted.items():
        allowed[a, b] = v
    for _ in range(200):
        inward, room = allowed.sum(axis=0), np.maximum(0.0, capacity - np.array(loads) + allowed.sum(axis=1))
        if (inward <= room + 0.5).all():
            break
        allowed *= np.where(inward > room + 0.5, room / np.maximum(inward, 1e-9), 1.0)
    whole = np.floor(allowed).astype(np.int64)
    for t in range(n):  # what rounding left over, to the largest fractions
        spare = int(allowed[:, t].sum() + 1e-6) - int(whole[:, t].sum())
        whole[np.argsort(whole[:, t] - allowed[:, t], kind="stable")[:spare], t] += 1
    return {(int(a), int(b)): int(whole[a, b]) for a, b in zip(*np.nonzero(whole))}


def _preferred(votes: Column, anchor: Column, n_shards: int, full: set[int]) -> Column:
    """The shard with most votes, a full one only for those in it; ties go to the same shard for a whole group."""
    ranked = F.array(
        *[
            F.struct((F.when(F.col("shard") == s, votes[s]).otherwise(-1.0) if s in full else votes[s]).alias("v"), F.xxhash64(anchor, F.lit(s)).alias("h"), F.lit(s).alias("s"))
            for s in range(n_shards)
        ]
    )
    return F.array_max(ranked)["s"]


def propose(members: DataFrame, n_members: int, n_shards: int, full: set[int] = frozenset()) -> DataFrame:
    """(rid, shard, anchor, target) of the documents that have neighbours; members: (rid, shard, link)."""
    counts = [F.sum(F.when(F.col("shard") == s, 1).otherwise(0)).alias(f"c{s}") for s in range(n_shards)]
    hubs = members.groupBy("link").agg(F.count(F.lit(1)).alias("total"), *counts)
    hubs = cut(hubs.where("total > 1"), "shard-hubs")
    shares = [F.sum(F.col(f"c{s}") / F.col("total")).alias(f"v{s}") for s in range(n_shards)]
    scored = join_counted(members, hubs, "link", "total", n_members).groupBy("rid", "shard").agg(F.min("link").alias("anchor"), *shares)
    votes = F.array(*[F.round(F.col(f"v{s}"), 9) for s in range(n_shards)])
    return scored.withColumn("_votes", votes).select(
        "rid", "shard", "anchor", _preferred(F.col("_votes"), F.col("anchor"), n_shards, full).alias("target")
    )


def _move(proposals: DataFrame, quotas: dict[tuple[int, int], int]) -> DataFrame:
    """The proposals with ``shard`` changed where they are granted."""
    spark = proposals.sparkSession
    level = F.pmod(F.xxhash64("anchor"), F.lit(LEVELS)).cast("int")
    moving = proposals.withColumn("level", level)
    sizes = moving.where("shard <> target").groupBy("shard", "target", "level").agg(F.count(F.lit(1)).alias("n")).collect()
    granted, left = [], dict(quotas)  # at most n_shards ** 2 * LEVELS rows
    for r in sorted(sizes, key=lambda r: (r["shard"], r["target"], r["level"])):
        room = left.get((r["shard"], r["target"]), 0)
        take = min(room, r["n"])
        left[r["shard"], r["target"]] = room - take
        if take:
            granted.append((r["shard"], r["target"], r["level"], take / r["n"]))
    table = spark.createDataFrame(granted, "shard int, target int, level int, part double")
    chance = F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    joined = moving.join(F.broadcast(table), ["shard", "target", "level"], "left")
    return joined.select(
        "rid", F.when(chance < F.col("part"), F.col("target")).otherwise(F.col("shard")).alias("shard"), "anchor"
    )


def shard_documents(
    docs: DataFrame, n_shards: int = 8, links: list[Column] | None = None, rounds: int = 4, id_col: str = "doc_id"
) -> DataFrame:
    """Deal ``docs`` into ``n_shards`` whose row counts differ by one at most, cutting few links.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('rows'), shard, slot (gapless from 0 in
    each shard), grown_shard (null: the law isn't 'key') and cut (whether most of its group is elsewhere).

    links: expressions of text keys; documents with an equal key are linked (null: no link by this key).
    By default the exact text. A group larger than a shard fills several, one after the other. Null texts: size 1,
    checksum 0, no link. Texts of any length count whole. Repeated rows are separate documents; of ties the
    order of the rows decides. A null doc_id comes first. An empty table gives an empty result. Other columns
    are ignored, whatever their names. A proposal has a few columns for each shard: for tens of shards, not
    for thousands.
    """
    text = F.col("text")
    keys = [F.md5(text)] if links is None else links
    nodes = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_bytes(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.filter(F.array(*keys), lambda k: k.isNotNull()).alias("links"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-nodes",
    )
    n = nodes.count()
    goal = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]

    start = F.pmod(F.xxhash64("doc_id", "rid"), F.lit(n_shards)).cast("int")
    member = nodes.select("rid", start.alias("shard"), F.explode(F.array_distinct("links")).alias("link"))
    hubs = cut(member.groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shard-hubs")
    # Only keys that link something.
    linked = cut(join_counted(member, hubs, "link", "_n", n).drop("_n"), "shard-links")
    n_linked = linked.count()

    labels, full = None, set()
    for _ in range(rounds):
        members = linked if labels is None else linked.drop("shard").join(labels.select("rid", "shard"), "rid")
        proposals = cut(propose(members, n_linked, n_shards, full), "shard-proposals")
        cells = proposals.groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()
        loads = [sum(r["n"] for r in cells if r["shard"] == s) for s in range(n_shards)]
        wanted = {(r["shard"], r["target"]): r["n"] for r in cells if r["shard"] != r["target"]}
        quotas = _grant(loads, wanted, n // n_shards)
        labels = cut(_move(proposals, quotas).join(proposals.select("rid", "target"), "rid"), "shard-labels")
        for (a, b), moved in quotas.items():
            loads[a], loads[b] = loads[a] - moved, loads[b] + moved
        full = {s for s in range(n_shards) if loads[s] >= n // n_shards}
        if not quotas:
            break

    if labels is None:
        labels = linked.groupBy("rid").agg(F.min("shard").alias("shard"), F.min("link").alias("anchor"), F.min("shard").alias("target"))
    placed = number_rows(
        labels, "_place", n, ["shard"], [F.col("anchor"), F.col("rid")], (F.col("shard") != F.col("target")).cast("int")
    )
    room = F.element_at(F.array(*[F.lit(g) for g in goal]), F.col("shard") + 1)
    kept = cut(placed.where(F.col("_place") < room).select("rid", "shard", (F.col("shard") != F.col("target")).alias("cut")), "shard-kept")
    held = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}

    rest = nodes.select("rid").join(kept, "rid", "left_anti")
    rest = number_rows(rest, "_turn", n, [], [F.col("rid")])
    until, total = F.lit(n_shards - 1), 0
    ends = []
    for s in range(n_shards):
        total += goal[s] - held.get(s, 0)
        ends.append((s, total))
    for s, end in reversed(ends):
        until = F.when(F.col("_turn") < end, s).otherwise(until)
    moved = linked.select("rid").distinct().withColumn("_linked", F.lit(True))
    filled = rest.join(moved, "rid", "left").select(
        "rid", until.cast("int").alias("shard"), F.coalesce("_linked", F.lit(False)).alias("cut")
    )
    whole = nodes.drop("links").join(kept.unionByName(filled), "rid")
    numbered = number_rows(cut(whole, "shard-whole"), "slot", n, ["shard"], [F.col("doc_id"), F.col("rid")])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cut"
    )
