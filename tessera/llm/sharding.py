"""Sharding by balanced label propagation, under the law that shards' row counts differ by one at most.

Documents are nodes; those with one link key (here: equal texts) are linked through a hub, so that a group of n
documents costs n edges. Groups of more than 1 / BIG of a shard, a bounded number, are placed first by their
sizes alone: whole where they fit, the largest first and on the fullest shard that takes them, then those that
fit nowhere, over as few shards as take them. The other documents share the room that is left. Each starts on
a hashed shard, in proportion to the room. In each round the hubs count their members
by shard, and members elsewhere ask to move to the shard that holds most of them. A plan over shard pairs,
made from counts alone, admits the moves: documents without links fill in the other way, and where a shard
lacks such fillers the moves into it are thinned. After the rounds what is left of a group follows its most. Last,
shards are filled to their quotas exactly: documents are
numbered within their shard, linked groups first and together, and those past the quota take the free slots
of other shards. So sizes are even, and edges are cut only where a large group fits nowhere or a small one
lies on a border.

Nulls: a null text has size 1 and links with empty texts; a null doc_id is a value like any other. Rows that
repeat get a slot each. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, hot_keys, join_spread, ranked, table, uniform

SHARDS = 8
ROUNDS = 4
#: Groups of more than this part of a shard are placed by the driver, SHARDS * BIG of them at most.
BIG = 64


def _place(sizes: list[int], quota: list[int]) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Of each group its parts (shard, documents), and the room that they leave on the shards."""
    room, parts = list(quota), [[] for _ in sizes]
    order = sorted(range(len(sizes)), key=lambda g: -sizes[g])
    late = []
    for g in order:
        fits = [s for s in range(len(room)) if room[s] >= sizes[g]]
        if not fits:
            late.append(g)
            continue
        s = min(fits, key=room.__getitem__)
        parts[g].append((s, sizes[g]))
        room[s] -= sizes[g]
    for g in late:
        left = sizes[g]
        while left:
            fits = [s for s in range(len(room)) if room[s] >= left]
            s = min(fits, key=room.__getitem__) if fits else max(range(len(room)), key=room.__getitem__)
            n = min(left, room[s])
            parts[g].append((s, n))
            room[s] -= n
            left -= n
    return parts, room


def _moves(asked: np.ndarray, load: np.ndarray, free: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the asked moves i -> j to admit, and of the free documents of i to send to j.

    asked[i, j], load[i] and free[i] count documents; afterwards each load is about the shard's room, as
    far as the free documents reach.
    """
    k = len(load)
    share = np.ones((k, k))
    for _ in range(20):
        moved = asked * share
        after = load + moved.sum(0) - moved.sum(1)
        over = after - room - free  # what the shard's free documents can't make room for
        tight = (over > 1) & (moved.sum(0) > 0)
        if not tight.any():
            break
        for j in np.flatnonzero(tight):
            share[:, j] *= max(0.0, 1 - over[j] / moved[:, j].sum())
    moved = asked * share
    after = load + moved.sum(0) - moved.sum(1)
    out, into = np.minimum(np.maximum(after - room, 0), free), np.maximum(room - after, 0)
    sent = np.outer(out, into) / max(into.sum(), 1e-9) * min(1.0, into.sum() / max(out.sum(), 1e-9))
    return share, sent / np.maximum(free, 1)[:, None]


def _at(matrix: np.ndarray, i: Column, j: Column) -> Column:
    flat = F.array(*[F.lit(float(x)) for x in matrix.ravel()])
    return flat[(i * F.lit(matrix.shape[1]) + j).cast("int")]


def _best(now: DataFrame) -> DataFrame:
    """now with _best: the shard that holds most of the row's group, its own where it has none."""
    tally = now.filter("_linked").groupBy("_link", "_shard").agg(F.count("*").alias("_n"))
    best = F.max(F.struct("_n", F.xxhash64("_link", "_shard"), "_shard"))["_shard"]
    return now.join(tally.groupBy("_link").agg(best.alias("_best")), "_link", "left").withColumn("_best", F.coalesce("_best", "_shard"))


def propagate(nodes: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """nodes (_key: a hash of the row, _link: what links rows, _linked) with _shard, filled about to the room."""
    shards, space = len(room), np.array(room, float)
    at = uniform(F.col("_key"), F.lit(0)) * F.lit(float(space.sum()))
    now = checkpointed(nodes.withColumn("_shard", F.size(F.filter(F.array(*[F.lit(float(x)) for x in np.cumsum(space)[:-1]]).cast("array<double>"), lambda x: x <= at)).cast("int")))
    for r in range(rounds):
        wish = _best(now)
        asked, load, free = np.zeros((shards, shards)), np.zeros(shards), np.zeros(shards)
        for c in wish.groupBy("_shard", "_best", "_linked").count().collect():  # at most 2 * shards ** 2 rows
            load[c["_shard"]] += c["count"]
            if not c["_linked"]:
                free[c["_shard"]] += c["count"]
            elif c["_shard"] != c["_best"]:
                asked[c["_shard"], c["_best"]] += c["count"]
        if not asked.any():
            break
        share, sent = _moves(asked, load, free, space)
        draw = uniform(F.col("_key"), F.lit(r + 1))
        admitted = F.when(draw < _at(share, F.col("_shard"), F.col("_best")), F.col("_best")).otherwise(F.col("_shard"))
        reach = np.cumsum(sent, 1)
        steps = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in reach])
        filled = F.size(F.filter(steps[F.col("_shard")], lambda x: x <= draw))
        filled = F.when(filled < shards, filled).otherwise(F.col("_shard"))
        now = checkpointed(wish.withColumn("_shard", F.when(F.col("_linked"), admitted).otherwise(filled).cast("int")).drop("_best"))
    return _best(now).withColumn("_shard", F.col("_best").cast("int")).drop("_best")


def _placed(nodes: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """nodes of large groups with _shard, and the room that they leave."""
    spark = nodes.sparkSession
    sizes = sorted((bytes(r["_link"]), r["count"]) for r in nodes.groupBy("_link").count().collect())  # at most shards * BIG rows
    parts, room = _place([n for _, n in sizes], quota)
    at, rows = 0, []
    for (link, _), places in zip(sizes, parts, strict=True):
        for s, n in places:
            rows.append((link, at, at + n, s))
            at += n
    pieces = F.broadcast(spark.createDataFrame(rows, "_link binary, _from bigint, _until bigint, _shard int"))
    placed = ranked(nodes, [F.col("_link"), F.col("doc_id").asc_nulls_first(), F.col("_key")], "_nth").join(pieces, "_link")
    return placed.filter("_nth >= _from and _nth < _until").drop("_nth", "_from", "_until"), room


def _tables(*lists: list[int]) -> list[Column]:
    return [F.array(*[F.lit(int(x)).cast("bigint") for x in xs]) for xs in lists]


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one per document."""
    text = F.coalesce("text", F.lit(""))
    nodes = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_link"))
    nodes = nodes.withColumn("_key", F.xxhash64("doc_id", "_link"))
    links = checkpointed(nodes.groupBy("_link").agg(F.count("*").alias("_n")).filter("_n > 1"))
    nodes = checkpointed(join_spread(nodes, links, "_link", hot_keys(links, "_link", "_n"), "left").withColumn("_linked", F.col("_n").isNotNull()))
    total = nodes.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = nodes.withColumn("_big", F.coalesce(F.col("_n") * BIG * shards > total, F.lit(False))).drop("_n")
    placed, room = _placed(nodes.filter("_big"), quota)
    now = propagate(nodes.filter("not _big"), room, rounds).unionByName(placed)
    # large groups, small ones together, then the documents without links, which give way first
    order = [F.col("_shard"), (~F.col("_big")), (~F.col("_linked")), F.col("_link"), F.col("doc_id").asc_nulls_first(), F.col("_key")]
    now = ranked(now, order, "_rank")
    held = {r["_shard"]: r["count"] for r in now.groupBy("_shard").count().collect()}
    counts = [held.get(s, 0) for s in range(shards)]
    starts, excess, gaps = [0], [0], [0]
    for n, q in zip(counts, quota, strict=True):
        starts.append(starts[-1] + n)
        excess.append(excess[-1] + max(n - q, 0))
        gaps.append(gaps[-1] + max(q - n, 0))
    start, room, had, before, gap = _tables(starts, quota, counts, excess, gaps)
    at = F.col("_shard")
    slot = F.col("_rank") - start[at]
    now = now.withColumn("_slot", slot).withColumn("_spare", F.when(slot >= room[at], before[at] + slot - room[at]))
    to = (F.size(F.filter(gap, lambda x: x <= F.col("_spare"))) - 1).cast("int")
    now = now.withColumn("shard", F.when(F.col("_spare").isNull(), at).otherwise(to))
    slot = F.when(F.col("_spare").isNull(), F.col("_slot")).otherwise(had[F.col("shard")] + F.col("_spare") - gap[F.col("shard")])
    return now.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
