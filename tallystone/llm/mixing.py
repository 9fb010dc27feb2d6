r"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Every word run ``[^\x20\x09-\x0D]+`` counts one. Sources have weights; their targets share ``share`` of all words in
proportion, but none takes more than ``most`` times what it has: the excess is shared again by weight among the others.
Targets become whole blocks of ``block`` words by highest quotients target / (2k + 1); each source's blocks go to its
shards in the same way, by the shards' words. What whole blocks leave of a target, because targets are no whole blocks and a shard's last
block may be short, is added to or taken from the quotas of the source's largest shards, word by word: a source gives its target, rounded. In a
shard the documents stand in seeded order and their words form blocks; a quota takes all words as often as it holds them all, and then
blocks by seeded choice, the last of them in part. What a document gives is what its words have in those blocks, so it
never gives more than ``most`` times its size.

Scale: a narrow table of sizes is written once; texts are never shuffled. The driver sees one row for each source (the
mix's own specification has as many) and one for each shard, of which a source has 4096 at most; a shard is a hash
of its documents, about ``SHARD_ROWS`` of them, or a 4096th of a larger source, so no task gets a hot source whole.
The choice depends on ids, texts and the seed only: reruns and other partitionings agree.

Null or empty text has size 0 and gives nothing. A null source is a source of its own, last in order. Repeated rows
are documents of their own; equal rows may give different amounts, but as a group always the same. Null ids work.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import _words as words
from tallystone.llm._shared import Scratch

BLOCK, MOST, SEED = 32, 3, 17
SHARD_ROWS, MAX_SHARDS = 2048, 4096


def cycle_weights(names: Sequence[str | None]) -> list[float]:
    """Weights 1, 2, 3, repeating, in the given order."""
    return [float(1 + i % 3) for i in range(len(names))]


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST, share: float = 1.0) -> list[float]:
    """``share`` of all words by weight; what exceeds ``most`` times a source's words is shared again by weight."""
    out, left, free = [0.0] * len(sizes), share * sum(sizes), [i for i in range(len(sizes)) if weights[i] > 0]
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        done = set(full)
        free = [i for i in free if i not in done]
    return out


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), no more than ``caps``; of equal quotients the first wins.

    Starts from rounded shares, which are a Sainte-Lague allotment for their own sum, and adds or takes back the few
    seats that are missing or too many by quotient, so the work doesn't grow with the seats.
    """
    caps = [seats] * len(votes) if caps is None else list(caps)
    total = float(sum(votes))
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    won = [min(c, int(v / total * seats + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    missing = seats - sum(won)
    if missing > 0:
        heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, won, strict=True)) if v > 0 and k < caps[i]]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heapq.heappop(heap)
            won[i] += 1
            if won[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    elif missing < 0:
        heap = [(votes[i] / (2 * k - 1), -i) for i, k in enumerate(won) if k]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heapq.heappop(heap)
            won[-i] -= 1
            if won[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * won[-i] - 1), i))
    return won


def fill(goal: float, sizes: Sequence[int], seats: Sequence[int], block: int = BLOCK, most: int = MOST) -> list[int]:
    """Words that each shard of a source gives: its seats' blocks, with the words that these miss of the goal, or have too many, at the largest shards."""
    held = [min(k * block, most * n) for k, n in zip(seats, sizes, strict=True)]
    gap = round(goal) - sum(held)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if not gap:
            break
        step = min(gap, most * sizes[i] - held[i]) if gap > 0 else -min(-gap, held[i])
        held[i] += step
        gap -= step
    return held


def taken(sizes: np.ndarray, quota: int, block: int, seed: int) -> np.ndarray:
    """Words that each document of a shard gives, in the given order, for a quota of words."""
    total = int(sizes.sum())
    n = -(-total // block)
    if not n:
        return np.zeros(len(sizes), np.int64)
    every, more = divmod(quota, total)
    ranks = words.mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    order = np.argsort(ranks, kind="stable")
    length = np.full(n, block, np.int64)
    length[-1] = total - block * (n - 1)
    # whole blocks in seeded order, the first words of the last one
    part = np.zeros(n + 1, np.int64)
    part[order] = np.clip(more - np.append(0, np.cumsum(length[order])[:-1]), 0, length[order])
    before = np.append(0, np.cumsum(part[:-1]))
    ends = np.append(0, np.cumsum(sizes))
    at = ends // block
    covered = before[at] + np.minimum(ends - at * block, part[at])
    return every * sizes + np.diff(covered)


def mix(spark: SparkSession, docs: DataFrame, weights: Callable[[Sequence[str | None]], Sequence[float]] = cycle_weights, share: float = 1.0, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``docs(doc_id, text, source)``.

    ``weights`` gets the sources in code point order, null last, and gives each one's weight.
    """
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09\x0A\x0B\x0C\x0D]+")), F.lit(0)).cast("long")
    sized = scratch.keep(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("tag")), "sized")
    found = {r.source: r for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    names = sorted((s for s in found if s is not None)) + [None] * (None in found)
    sizes = [found[s].size for s in names]
    goal = targets(sizes, weights(names), most, share)
    shards = [min(MAX_SHARDS, -(-found[s].rows // SHARD_ROWS)) for s in names]
    plan = spark.createDataFrame([(i, s, sizes[i], goal[i], shards[i]) for i, s in enumerate(names)], "at int, name string, source_size long, target double, shards int")
    cells = sized.join(plan, sized["source"].eqNullSafe(plan["name"])).select("at", F.pmod(F.xxhash64("tag"), F.col("shards")).cast("int").alias("shard"), "doc_id", "source", "size", "tag", "source_size", "target")
    held: list[dict[int, int]] = [{} for _ in names]
    for r in cells.groupBy("at", "shard").agg(F.sum("size").alias("size")).collect():
        held[r.at][r.shard] = r.size
    won = sainte_lague(goal, round(sum(goal) / block), [most * sum(-(-t // block) for t in x.values()) for x in held])
    quotas = []
    for i, x in enumerate(held):
        keys = sorted(x)
        own = [x[k] for k in keys]
        seats = sainte_lague(own, won[i], [most * -(-n // block) for n in own])
        quotas += [(i, k, q) for k, q in zip(keys, fill(goal[i], own, seats, block, most), strict=True)]
    quota = spark.createDataFrame(quotas, "at int, shard int, quota long")

    def choose(table: pa.Table) -> pa.Table:
        tag = table.column("tag").to_numpy()
        n = table.column("size").to_numpy()
        ids = table.column("doc_id").fill_null(0).to_numpy()
        order = np.lexsort((n, ids, tag))
        own = seed + (table.column("at")[0].as_py() << 32) + table.column("shard")[0].as_py()
        out = np.empty(len(n), np.int64)
        out[order] = taken(n[order], table.column("quota")[0].as_py(), block, own)
        return table.select(["doc_id", "source", "size", "source_size", "target"]).append_column("taken", pa.array(out))

    cells = cells.withColumn("doc_id", F.col("doc_id").cast("long")).join(quota, ["at", "shard"])
    return cells.groupBy("at", "shard").applyInArrow(choose, "doc_id long, source string, size long, source_size long, target double, taken long")
