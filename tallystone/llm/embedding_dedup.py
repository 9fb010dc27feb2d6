"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its ``near`` nearest pivots, nearest first. Each pivot has an inverted list of the vectors that
name it; two vectors are candidates if they share at least ``shared`` pivots (all, if there are fewer). Every candidate pair is verified by the
cosine in double precision, so no link is false; the index may miss some (recall is measured in the tests).

Pivots are fitted on a bounded sample: the ``SAMPLE`` valid vectors of the least hash, thinned so that no two pivots have
a cosine above ``APART`` (else a large group of near copies would draw most pivots to itself and split its members among
them), and no more than (vectors * near / LIST), 64 at least. All vectors are indexed.

Scale: equal vectors of one label are one node with a count. A pair is counted only in the list of the first pivot that both
share; as it shares ``shared`` of them, the last ones of a vector need no list. A list of more than ``SPLIT`` vectors is replaced by
lists of two pivots, the first two that a pair shares, and these in turn by lists of three, so that lists don't
grow with the table, though the pivots are bounded. Lists are cut into blocks of ``BLOCK`` vectors and pairs of
blocks are compared by matrix products in separate tasks, so that a hot list is spread out and memory is bounded. No
pairs leave a block: only counts per vector, and one link for each vector to the least of its part of the block, for
the components. Vectors of a group of g different near copies are still compared with each other, g * g / 2 times.

Vectors are scaled by a power of two first, which is exact, so that very large and very small ones have a norm.

Only vectors of equal, non-null label and equal dimension are compared. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing: n_links 0, component its own id. Repeated rows count as different vectors
(cosine 1). Null vec_ids work; a component's id is null only if it has no other. Extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tallystone.llm._shared import Scratch, components, told_apart

COSINE = 0.93
NEAR, SHARED = 10, 3
SAMPLE, APART, LIST, BLOCK, SPLIT = 8192, 0.7, 2048, 512, 4096


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 0.5 or more, and below 1."""
    return np.ldexp(x.astype(np.float64), -np.frexp(np.abs(x).max(1, keepdims=True).astype(np.float64))[1])


def pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors of the sample, in order, of which no two are closer than ``APART``."""
    unit = _scaled(sample)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    chosen = np.empty((min(most, len(unit)), unit.shape[1]))
    n = 0
    for x in unit:
        if n == len(chosen):
            break
        if not n or (chosen[:n] @ x).max() <= APART:
            chosen[n] = x
            n += 1
    return chosen[:n]


def nearest(vectors: np.ndarray, points: np.ndarray, near: int) -> np.ndarray:
    """The permutation prefix of each vector: indices of its nearest points, nearest first; of equal ones the first."""
    unit = _scaled(vectors)
    score = (unit / np.linalg.norm(unit, axis=1, keepdims=True)) @ points.T
    return np.argsort(-score, axis=1, kind="stable")[:, :near]


def _shared(a: np.ndarray, b: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair: pivots that both name, and how many of those are before ``pivot``."""
    names = np.unique(np.concatenate([a.ravel(), b.ravel()]))
    flags = []
    for x in (a, b):
        f = np.zeros((len(x), len(names)), np.float32)
        f[np.arange(len(x))[:, None], np.searchsorted(names, x)] = 1
        flags.append(f)
    before = names < pivot
    return flags[0] @ flags[1].T, flags[0][:, before] @ flags[1][:, before].T


def _compare(cosine: float, need: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        pivots_, i, j = (key[k].as_py() for k in (2, 3, 4))
        x, prefix = _scaled(_matrix(table.column("v"))), _matrix(table.column("prefix"))
        node, count, own = (table.column(c).to_numpy() for c in ("node", "n", "own"))
        norm = np.linalg.norm(x, axis=1)
        sides = (np.flatnonzero(own == i), np.flatnonzero(own == j))
        out_a, out_b, out_n = [], [], []
        for start in range(0, len(sides[0]), BLOCK):  # chance may overfill a block; memory stays bounded
            a = sides[0][start : start + BLOCK]
            for other in range(0, len(sides[1]), BLOCK):
                b = sides[1][other : other + BLOCK]
                both, before = _shared(prefix[a], prefix[b], pivots_[-1])
                link = (both >= min(need, prefix.shape[1])) & (before == len(pivots_) - 1) & ((x[a] @ x[b].T) / np.outer(norm[a], norm[b]) >= cosine)
                if i == j:
                    link &= node[a][:, None] != node[b][None, :]
                if not link.any():
                    continue
                out_a += [node[a], node[b][: 0 if i == j else None]]
                out_n += [link @ count[b], (link.T @ count[a])[: 0 if i == j else None]]
                out_b += out_a[-2:]
                member, first = _joining(link, node[a], node[b])
                out_a.append(member)
                out_b.append(first)
                out_n.append(np.zeros(len(member), np.int64))
        if not out_a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b, n = (np.concatenate(x).astype(np.int64) for x in (out_a, out_b, out_n))
        some = (n > 0) | (a != b)
        return pa.table({"a": a[some], "b": b[some], "n": n[some]})

    return run


def _joining(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for each connected part of a block's links."""
    label = np.concatenate([a, b])
    n = len(a)
    while True:
        new = label.copy()
        new[:n] = np.minimum(new[:n], np.where(link, label[n:][None, :], np.iinfo(np.int64).max).min(1))
        new[n:] = np.minimum(new[n:], np.where(link, new[:n][:, None], np.iinfo(np.int64).max).min(0))
        if (new == label).all():
            break
        label = new
    every = np.concatenate([a, b])
    moved = every != label
    return every[moved], label[moved]


def near_duplicates(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, near: int = NEAR, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``."""
    scratch = Scratch(spark, "embedding-dedup")
    finite = F.forall(F.coalesce("v", F.array()), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kind = "float" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), True) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    valid = F.coalesce(F.col("v").isNotNull() & F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(valid, F.xxhash64("label", "v")))
    rows = scratch.keep(rows.withColumn("twin", F.xxhash64(F.lit(1), "v", "label")), "rows")
    rows = told_apart(scratch, rows, "node", "twin").drop("twin")
    nodes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = scratch.keep(nodes, "nodes")
    distinct = rows.where("node is not null").dropDuplicates(["node"]).select("node", "label", F.size("v").alias("dim"), "v").join(nodes.select("node", "n"), "node")
    distinct = scratch.keep(distinct, "distinct")

    total = distinct.count()
    points: dict[int, np.ndarray] = {}
    sample = distinct.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks() if total else pa.array([], pa.list_(pa.float64()))
    most = max(64, total * near // LIST)
    dims = sample.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        points[dim] = pivots(_matrix(sample.filter(pa.array(dims == dim))), most)
    held = spark.sparkContext.broadcast(points)

    def describe(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column(3))
                known = held.value.get(dim)
                prefix = np.sort(nearest(x, known, near), axis=1) if known is not None else np.zeros((len(x), 1), np.int32)
                flat = pa.array(prefix.ravel().astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prefix.size + 1, prefix.shape[1], dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["node", "label", "dim", "v", "n", "prefix"])

    described = distinct.select("node", "label", "dim", "v", "n").mapInArrow(describe, f"node long, label string, dim int, v array<{kind}>, n long, prefix array<int>")
    described = scratch.keep(described, "described")
    need = min(shared, near)
    found = described.select("node", "label", "dim", "n", "v", "prefix").withColumn("key", F.array().cast("array<int>")).withColumn("pivot", F.lit(-1))
    posted = []
    for level in range(1, need + 1):
        # a pair shares ``need`` pivots, or all, so its first ``level`` ones have as many after them as are wanting
        after = F.filter("prefix", lambda x: x > F.col("pivot"))
        last = F.size(after) - (F.least(F.lit(need), F.size("prefix")) - level)
        found = found.withColumn("pivot", F.explode(F.slice(after, F.lit(1), F.greatest(last, F.lit(0)))))
        found = found.withColumn("key", F.concat("key", F.array("pivot")))
        lists = found.groupBy("label", "dim", "key").agg(F.count("*").alias("held"), F.min(F.size("prefix")).alias("names")).where("held > 1")
        final = (F.least(F.lit(need), F.col("names")) <= level) | (F.col("held") <= SPLIT)
        lists = scratch.keep(lists.select("label", "dim", "key", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), final.alias("final")), f"lists-{level}")
        met = found.join(scratch.small(lists, f"lists-{level}"), ["label", "dim", "key"])
        posted.append(met.where("final").drop("final"))
        if lists.where("not final").isEmpty():
            break
        found = met.where("not final").drop("final", "blocks")
    postings = functools.reduce(DataFrame.unionByName, posted)
    postings = postings.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    postings = postings.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    postings = postings.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    found = postings.select("label", "dim", "key", "i", "j", "own", "node", "n", "v", "prefix").groupBy("label", "dim", "key", "i", "j").applyInArrow(_compare(cosine, need), "a long, b long, n long")
    found = scratch.keep(found, "links")
    root = components(scratch, found.select("a", "b"), "part")
    counts = found.groupBy("a").agg(F.sum("n").alias("others"))
    # written, so that the join with a large component's rows is dealt by itself and can be split
    named = scratch.keep(nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = scratch.keep(named.groupBy("root").agg(F.min("least").alias("component")), "of-root")
    named = named.join(scratch.small(least, "of-root"), "root").join(counts, named["node"] == counts["a"], "left").select("node", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component")
    named = scratch.keep(named, "named")
    scratch.clear("rows", "shared-keys", "named")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
