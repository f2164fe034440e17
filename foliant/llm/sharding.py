"""Sharding by balanced label propagation: linked documents move together, shards stay even.

Documents are linked through hubs: two documents of one hub (equal texts, or
whatever columns a caller names) are neighbours, without a row per pair.  All documents
start dealt out evenly.  A round joins the documents with the label counts of
their hubs; each then wants the shard that holds most of its neighbours (of equal
ones the first, so two halves of a group do not swap places for ever).  Wishes are
granted under capacity quotas: a shard takes as many newcomers as it gives up
residents, where documents without links fill every gap; small groups go first,
since they can be whole.  A shard with nothing left to give is full, and later rounds
pass over it, so a group larger than a shard fills one shard after the other.  The
rounds end when nothing moves.

Each round leaves every shard with the count it had: the law is ``rows``, counts
at most one apart.  Ranks (first places, quotas, slots) come from range-partitioned sorts and
the counts of their partitions, so a hub or shard with a third of all rows is no single
task.  Only tables of shards by shards reach the driver.

Defined cases: a null text has size 1, checksum 0 and no links; empty texts, like any other
equal texts, are a group; repeated rows are documents of their own; a null doc_id
comes first; with fewer documents than shards some shards stay empty; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.lineage import discard, materialize

SHARDS, ROUNDS = 16, 24
LINE = (1 << 33) - 1  # the lower bits of monotonically_increasing_id: the row within its partition


def numbered(rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``rows`` with their gapless place from 0 in ``order``, counted anew in each group of the columns ``within``.

    A range-partitioned sort; the counts of (partition, group) say where a
    group goes on in the next partition, so no group has to fit in a task.  There
    are about as many counts as partitions and groups together.
    """
    first, line = [F.col(c) for c in within], F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order)
    placed = materialize(placed.select("*", F.shiftright(line, 33).alias("_part"), line.bitwiseAND(F.lit(LINE)).alias("_line")), "sorted")
    counts = placed.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_line").alias("_first"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    return placed.join(counts.select("_part", *within, shift.alias("_shift")), ["_part", *within]).select(
        *rows.columns, (F.col("_line") + F.col("_shift")).alias(name))


def nodes_of(docs: DataFrame, links: Sequence[Column]) -> DataFrame:
    """``(node, doc_id, size, text_crc32, hubs)``: ``node`` is the place in order of doc_id, ``hubs`` the hashed link values."""
    text = F.coalesce("text", F.lit(""))
    hubs = F.filter(F.array(*[F.when(c.isNotNull(), F.xxhash64(F.lit(k), c)) for k, c in enumerate(links)]), lambda h: h.isNotNull())
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"), hubs.alias("hubs"))
    narrow = materialize(narrow, "narrow")
    # Rows that share all of this are told apart by their place in the written table.
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_row")]
    return materialize(numbered(narrow.withColumn("_row", F.monotonically_increasing_id()), order, name="node").drop("_row"), "nodes")


def wishes(linked: DataFrame, closed: Sequence[int]) -> DataFrame:
    """``(node, own, target, gain, hub)`` of the nodes that want to leave: the shard of most neighbours, of equal ones an open one, then the first."""
    votes = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    table = votes.groupBy("hub").agg(F.collect_list(F.struct("shard", "n")).alias("votes"))  # at most one entry per shard
    table = materialize(table.filter(F.size("votes") > 1), "votes")
    asked = linked.join(table, "hub").select("node", "hub", F.col("shard").alias("own"), F.explode("votes").alias("v"))
    asked = asked.filter((~F.col("v.shard").isin(list(closed))) | (F.col("v.shard") == F.col("own")))
    score = asked.groupBy("node", "own", "v.shard").agg(F.sum("v.n").alias("n"), F.min("hub").alias("hub"))
    still = (~F.col("shard").isin(list(closed))).alias("open")
    best = score.groupBy("node", "own").agg(
        F.max(F.struct("n", still, (-F.col("shard")).alias("s"))).alias("b"), F.min("hub").alias("hub"),
        F.coalesce(F.max(F.when(F.col("shard") == F.col("own"), F.col("n"))), F.lit(0)).alias("here"))
    best = best.select("node", "own", (-F.col("b.s")).alias("target"), (F.col("b.n") - F.col("here")).alias("gain"), "hub")
    return materialize(best.filter("own <> target"), "wishes")


def quotas(wanted: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """How many of ``wanted[a, b]`` may move: no shard takes in more than leave it and ``spare`` residents make room for."""
    granted = wanted.copy()
    while True:
        room = spare + granted.sum(axis=1)
        over = np.flatnonzero(granted.sum(axis=0) > room)
        if not len(over):
            return granted
        for b in over:
            share = granted[:, b] * int(room[b]) // int(granted[:, b].sum())
            for a in np.argsort(share - granted[:, b])[: int(room[b] - share.sum())]:
                share[a] += 1
            granted[:, b] = share


def fillers(granted: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(from, first rank, end rank, to) of the unlinked documents that keep the counts of all shards."""
    net = granted.sum(axis=0) - granted.sum(axis=1)  # surplus of newcomers
    out, gaps = [], [[b, int(-n)] for b, n in enumerate(net) if n < 0]
    for a, n in enumerate(net.tolist()):
        done = 0
        while done < n:
            take = min(n - done, gaps[0][1])
            out.append((a, done, done + take, gaps[0][0]))
            done, gaps[0][1] = done + take, gaps[0][1] - take
            if not gaps[0][1]:
                gaps.pop(0)
    return out


def _moved(rows: DataFrame, moves: DataFrame, label: str) -> DataFrame:
    to = moves.select("node", F.col("target").alias("_to"))
    return materialize(rows.join(to, "node", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to"), label)


def propagate(linked: DataFrame, free: DataFrame, shards: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The labels of linked ``(node, hub, shard)`` and free ``(node, shard)`` rows after the rounds; counts of shards stay."""
    spark, closed = linked.sparkSession, set()
    for _ in range(rounds):
        movers = wishes(linked, sorted(closed))
        wanted, spare = np.zeros((shards, shards), np.int64), np.zeros(shards, np.int64)
        for r in movers.groupBy("own", "target").agg(F.count(F.lit(1)).alias("n")).collect():  # shards by shards
            wanted[r.own, r.target] = r.n
        if not wanted.any():
            break
        for r in free.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
            spare[r.shard] = r.n
        granted = quotas(wanted, spare)
        closed |= {b for b in range(shards) if wanted[:, b].any() and not granted[:, b].any()}
        if not granted.any():
            continue
        a, b = np.nonzero(wanted)
        cells = list(zip(a.tolist(), b.tolist(), granted[a, b].tolist(), (granted < wanted)[a, b].tolist(), strict=True))
        limits = spark.createDataFrame(cells, "own int, target int, _most long, _cut boolean")
        asked = movers.join(F.broadcast(limits), ["own", "target"])  # at most one row per pair of shards
        going = asked.filter("NOT _cut").select("node", "target")
        if (granted < wanted).any():
            ranked = numbered(asked.filter("_cut AND _most > 0"), [F.col("gain"), F.col("hub"), F.col("node")], ["own", "target"])
            going = going.union(ranked.filter("rank < _most").select("node", "target"))
        new = _moved(linked, going, "linked")
        spans = fillers(granted)
        if spans:
            table = spark.createDataFrame(spans, "shard int, _lo long, _hi long, target int")
            leaving = numbered(free.join(F.broadcast(table.select("shard").distinct()), "shard", "left_semi"), [F.col("node")], ["shard"])
            leaving = leaving.join(F.broadcast(table), ["shard"]).filter("rank >= _lo AND rank < _hi")  # at most two rows per shard
            moved = _moved(free, leaving.select("node", "target"), "free")
            discard(free)
            free = moved
        discard(linked, movers)
        linked = new
    return linked, free


RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, shards: int = SHARDS, links: Sequence[Column] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``RESULT`` of every document; ``links`` (default: the text) are the columns whose equal values link documents."""
    links = [F.col("text")] if links is None else list(links)
    nodes = nodes_of(docs, links)
    dealt = nodes.select("node", F.col("hubs"), F.pmod("node", F.lit(shards)).cast("int").alias("shard"))
    each = dealt.select("node", F.explode("hubs").alias("hub"), "shard")
    common = materialize(each.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hub"), "hubs")
    linked = materialize(each.join(common, "hub", "left_semi"), "linked")
    free = materialize(dealt.select("node", "shard").join(linked.select("node").distinct(), "node", "left_anti"), "free")
    linked, free = propagate(linked, free, shards, rounds)
    labels = linked.select("node", "shard").distinct().union(free.select("node", "shard"))
    placed = numbered(nodes.drop("hubs").join(labels, "node"), [F.col("node")], ["shard"], "slot")
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select(*RESULT)
