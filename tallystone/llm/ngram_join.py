r"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct word shingles (words are runs of ``[^\x20\x09-\x0D]``, A-Z lower-cased; a text
of fewer words is one shingle; no words, no shingles, no links). Two documents link when their sets' Jaccard
similarity reaches ``percent``/100, compared exactly in integers.

A partner of a set of n shingles shares at least T = ceil(percent * n / 100) of them. Every shingle has an inverted
list. As in DivideSkip, a set's lists fall into short ones, which are merged, and L long ones, which are only
probed by binary search: a partner must occur in at least T - L of the short lists. This is done twice.

Between groups, over all data: one fixed order of all shingles puts those with long lists last, then goes by the sum of their
frequent words' weights, then by hash. Which lists are long is counted over all documents, for the first 2 (n - T + c)
shingles of each in the order that frequent words give. The first n - T + c lists in that order are merged, the rest
are long (c is MERGED, MERGED_PERCENT of n if that is more, and at most T). Spark's external sort merges, spilling where
a heap would fill memory. The order affects the cost only; with any order every pair that links shares c merged lists.

Inside a group, in memory: classes (equal sets are one class) that share c merged lists with a list's least class form
groups; near copies come together there. A group's classes meet in blocks of ``BLOCK``, each pair of blocks in a task of
its own, by DivideSkip over the block's inverted lists. All links are found and counted there, per class and weighted by
its documents; as rows only those leave the task that join something, and the counts, so the pairs of a large group are
never rows. Two classes of different groups that link share c lists: more than a quarter of c are lists
where the one's group is a crowd, and then the other is drawn into that group, one row for it and the crowd; or more than
a quarter are lists where the other's is; or else at least half are lists where neither is, and the two are a pair, probed
by itself.

Nothing is sampled or capped. Frequent words are those of at least ``FREQUENT`` of all documents; there are at most
(mean distinct words of a document) / FREQUENT of them. Long lists are those of more than ``LONG`` documents, or of so many more
that there are ``LONG_LISTS`` of them at most. This bounds the tables that are sent to the executors; a long list beyond
that bound is merged like a short one, so it costs time, not links.

Null or empty texts have no shingles and a component of their own. Rows with equal doc_id but different texts are
different documents. A component's id is its least doc_id; null ids are passed over and the id is null only if a
component has no other. Repeated rows give repeated result rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import _words as words
from tallystone.llm._shared import Scratch, components, rekeyed, told_apart

#: A word is frequent if at least this share of the documents has it, and FEW of them at least.
FREQUENT, FEW = 1 / 4000, 8
#: Merged lists in which a candidate must occur: so many, and so many of a hundred shingles, or T where that is less.
MERGED, MERGED_PERCENT = 5, 3
#: Classes that meet in one block, and classes of a list that are paired in one task.
BLOCK = 256
#: A group with so many classes in a list is met there as a whole.
CROWD = 16
#: Documents of a list beyond which it is long, and long lists that are known as such.
LONG, LONG_LISTS = 16, 1 << 20
#: DivideSkip's weight of a probe against a step of the merge.
PROBE = 0.0085
#: Weight of a long list, beyond any sum of frequent words' weights.
_LAST = np.int32(1 << 20)


def overlap(n, percent: int):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def merged(n, percent: int):
    """Merged lists that a set of n must share with a partner that isn't smaller."""
    return min(max(MERGED, -(-MERGED_PERCENT * n // 100)), overlap(n, percent))


def _batches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, off in words.spans(column):
        yield row, *words.word_hashes(data, off)


def _word_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of at least a quarter of the wanted share of this partition's documents, with their counts.

    A word of the wanted share overall has it in some partition, and loses less than a quarter elsewhere.
    """
    keys, counts, held, waiting, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, 0

    def combined():
        new, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
        both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)

    for batch in rows:
        for _, hashes, begins in _batches(batch.column(0)):
            docs += len(begins) - 1
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                held.append(words.distinct(hashes[a:b]))
                waiting += b - a
            if waiting > 1 << 21:
                keys, counts = combined()
                held, waiting = [], 0
    keys, counts = combined()
    most = counts >= max(2, docs * FREQUENT / 4)
    yield pa.RecordBatch.from_arrays([pa.array(keys[most].view(np.int64)), pa.array(counts[most])], ["word", "n"])


def frequent_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent words and their weights, larger for more documents."""
    total = docs.count()
    least = max(FEW, total * FREQUENT)
    found = docs.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= 0.75 * least).toArrow()
    keys, n = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], (1 + 2 * np.log2(np.maximum(n[order] / (0.75 * least), 1))).astype(np.int16)


def _weights(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, weight = frequent
    if not len(keys):
        return np.zeros(len(hashes), np.int16)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, weight[at], np.int16(0))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _node(shingles: np.ndarray, kind: int = 0) -> int:
    """A class's key: a hash of its sorted set; ``kind`` 1: its twin, by which equal keys of different sets are told."""
    if not len(shingles):
        return 0
    spread = words.mix(shingles + np.uint64(len(shingles)) + words._ODD[1] * np.uint64(kind))
    return int(words.mix(np.bitwise_xor.reduce(spread, keepdims=True) + np.add.reduce(shingles * words._ODD[3 * kind])).view(np.int64)[0])


def described(docs: DataFrame, n: int, percent: int, known, times: int = 1) -> DataFrame:
    """(doc_id, mark, n_shingles, node, twin, prefix): a hash of the text, the set's size, its class twice, and the shingles whose lists are merged.

    ``known``: broadcast frequent words with their weights, and shingles with long lists. The prefix is ``times`` as long as it must be.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, long = known.value
        for batch in rows:
            sizes, nodes, twins, prefixes = [], [], [], []
            for _, hashes, begins in _batches(batch.column(2)):
                weight = _weights(hashes, frequent).astype(np.int32)
                per_word = np.zeros(max(len(hashes) - n + 1, 0), np.int32)
                for j in range(n if len(per_word) else 0):
                    per_word += weight[j : len(hashes) - n + 1 + j]
                for a, found in zip(begins[:-1].tolist(), words.shingle_hashes(hashes, begins, n), strict=True):
                    order = np.argsort(found, kind="stable")
                    found = found[order]
                    first = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
                    found, order = found[first], order[first]
                    size = len(found)
                    sizes.append(size)
                    nodes.append(_node(found))
                    twins.append(_node(found, 1))
                    reach = times * (size - overlap(size, percent) + merged(size, percent))
                    # a set that can have no partner but its equals needs no lists
                    if size and overlap(size + 1, percent) <= size:
                        weight_of = per_word[a + order]
                        if len(long):
                            weight_of = weight_of + _LAST * (long[np.minimum(np.searchsorted(long, found), len(long) - 1)] == found)
                        rank = np.argsort(weight_of, kind="stable")
                        prefixes.append(found[rank[:reach]])
                    else:
                        prefixes.append(found[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), _lists(prefixes)], ["doc_id", "mark", "n_shingles", "node", "twin", "prefix"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, node long, twin long, prefix array<long>")


def long_lists(scratch: Scratch, docs: DataFrame, n: int, percent: int, frequent) -> np.ndarray:
    """Sorted shingles with long lists, the longest ``LONG_LISTS`` or fewer."""
    none = np.zeros(0, np.uint64)
    found = described(docs, n, percent, scratch.spark.sparkContext.broadcast((frequent, none)), times=2)
    held = found.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > LONG)
    held = scratch.keep(held, "long")
    steps = held.groupBy(F.floor(F.log2("held")).alias("power")).agg(F.count("*").alias("lists"), F.min("held").alias("least")).orderBy(F.desc("power")).collect()
    least, lists = None, 0
    for r in steps:  # 64 rows at most
        lists += r.lists
        if lists > LONG_LISTS:
            break
        least = r.least
    tokens = none if least is None else np.sort(held.where(F.col("held") >= least).select("token").toArrow().column("token").to_numpy().view(np.uint64))
    scratch.drop("long")
    return tokens


def _probe(percent: int):
    """Which candidates (a, b, p, q, m, n) link; m and n are the documents of either class."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            off, flat = zip(*((x.offsets.to_numpy(), x.values.to_numpy().view(np.uint64)) for x in (batch.column(2), batch.column(3))), strict=True)
            keep = []
            for i in range(batch.num_rows):
                p, q = (flat[k][off[k][i] : off[k][i + 1]] for k in (0, 1))
                if len(p) > len(q):
                    p, q = q, p
                need = -(-percent * (len(p) + len(q)) // (100 + percent))
                ok = need <= len(p)
                hit = 0
                for start in range(0, len(p) if ok else 0, 256):  # binary probes; given up once too many have missed
                    part = p[start : start + 256]
                    hit += int(np.count_nonzero(q[np.minimum(np.searchsorted(q, part), len(q) - 1)] == part))
                    if hit + len(p) - min(start + 256, len(p)) < need:
                        break
                keep.append(ok and hit >= need)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1, 4, 5)], ["a", "b", "m", "n"]).filter(pa.array(keep, pa.bool_()))

    return run


def divide_skip(lists: np.ndarray, begins: np.ndarray, columns: int, codes: np.ndarray, need: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that at least ``need`` of the lists ``codes`` hold, among those that ``open_`` allows, and how many hold each.

    List k is ``lists[begins[k]:begins[k + 1]]``, rising column numbers.
    """
    length = begins[codes + 1] - begins[codes]
    codes, length = codes[length > 0], length[length > 0]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) < need:
        return none
    order = np.argsort(length, kind="stable")
    codes = codes[order]
    skipped = min(need - 1, int(need / (PROBE * np.log2(max(2, length.max())) + 1)))
    short, long = codes[: len(codes) - skipped], codes[len(codes) - skipped :]
    held = np.bincount(np.concatenate([lists[begins[k] : begins[k + 1]] for k in short.tolist()]), minlength=columns)
    found = np.flatnonzero((held >= need - skipped) & open_)
    count = held[found]
    for part in np.array_split(long, max(1, len(long) // 32)) if len(long) else ():  # drop what can't reach T any more
        if not len(found):
            return none
        probes = part[:, None] * columns + found[None, :]
        keys = np.concatenate([lists[begins[k] : begins[k + 1]] + k * columns for k in np.sort(part).tolist()])
        at = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
        count = count + (keys[at] == probes).sum(0)
        skipped -= len(part)
        stay = count + skipped >= need
        found, count = found[stay], count[stay]
    return found, count


def _search(percent: int, counts: bool):
    """T-occurrence join of two blocks of a group: (a, b, 0) for links, without those that join nothing new in the block.

    With ``counts`` also (a, a, documents that link with those of class a here, but for its own), which needs all links; else those
    that join nothing new aren't searched.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own, node, docs = (table.column(c).to_numpy() for c in ("own", "node", "docs"))
        sets = table.column("set").combine_chunks()
        off, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        part = [np.flatnonzero(own == k) for k in (i, j)]
        label, linked = np.arange(len(node)), np.zeros(len(node), np.int64)
        out: list[tuple[int, int, int]] = []
        for start in range(0, len(part[1]), 2 * BLOCK):  # chance may overfill a block; memory stays bounded
            right = part[1][start : start + 2 * BLOCK]
            size = off[right + 1] - off[right]
            tokens = np.concatenate([flat[off[x] : off[x + 1]] for x in right.tolist()])
            known, codes = np.unique(tokens, return_inverse=True)
            order = np.argsort(codes, kind="stable")
            lists = np.repeat(np.arange(len(right)), size)[order]
            begins = np.searchsorted(codes[order], np.arange(len(known) + 1))
            for x in part[0].tolist():
                mine = flat[off[x] : off[x + 1]]
                n = len(mine)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                at = at[known[at] == mine]
                open_ = 100 * np.minimum(size, n) >= percent * np.maximum(size, n)
                if not counts:
                    open_ &= label[right] != label[x]
                if i == j:
                    open_ &= right > x
                found, count = divide_skip(lists, begins, len(right), at, overlap(n, percent), open_)
                other = right[found[count * (100 + percent) >= percent * (size[found] + n)]]
                linked[x] += docs[other].sum()
                linked[other] += docs[x]
                for y in other[np.unique(label[other], return_index=True)[1]].tolist():  # one for each part of the block
                    if label[y] != label[x]:
                        label[label == label[y]] = label[x]
                        out.append((int(node[x]), int(node[y]), 0))
        if counts:
            some = np.flatnonzero(linked)
            out += zip(node[some].tolist(), node[some].tolist(), linked[some].tolist(), strict=True)
        a, b, n = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _sets_of(scratch: Scratch, docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int, name: str) -> DataFrame:
    """``wanted``, distinct by its column node, with each class's set, made again from one of its documents, and the number of these."""
    ids = nodes.join(wanted.select("node"), "node", "left_semi").groupBy("node", "doc_id").agg(F.count("*").alias("rows"))
    one = ids.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rows")).alias("m"), F.sum("rows").alias("docs"))
    one = scratch.keep(one.select("node", F.col("m.doc_id").alias("id"), F.col("m.rows").alias("rows"), "docs").join(wanted, "node"), name, F.max("rows").alias("most"))
    text = docs.join(scratch.small(one, name), F.col("doc_id").eqNullSafe(F.col("id")))
    columns = [c for c in one.columns if c not in ("id", "rows", "node")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [words.distinct(x) for _, hashes, begins in _batches(batch.column(1)) for x in words.shingle_hashes(hashes, begins, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([_node(x, k) for x in found], pa.int64()) for k in (0, 1)), _lists(found), *batch.columns[2:]], ["want", "key", "twin", "set", *columns])

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in one.schema if f.name in columns)
    sets = text.select(F.col("node").alias("want"), "text", *columns).mapInArrow(run, f"want long, key long, twin long, set array<long>{kinds}")
    sets = sets.where((F.col("want") == F.col("key")) | (F.col("want") == rekeyed("key", "twin"))).drop("key", "twin").withColumnRenamed("want", "node")
    # rows of equal id and set would come twice
    return sets.dropDuplicates(["node"]) if (scratch.figures[name]["most"] or 0) > 1 else sets


def join(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, counts: bool = True) -> DataFrame:
    """(doc_id, mark, n_shingles, node, root, component_id, n_links) for each row of ``docs(doc_id, text)``.

    Equal sets have one node, components one root; these tell documents of equal ids apart. ``n_links``: other rows that
    the document links with. Without ``counts`` it is null, and links that join nothing new are not searched.
    """
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = frequent_words(docs)
    known = spark.sparkContext.broadcast((frequent, long_lists(scratch, docs, shingle, percent, frequent)))
    rows = told_apart(scratch, scratch.keep(described(docs, shingle, percent, known), "rows"), "node", "twin")
    nodes = rows.where("n_shingles > 0").select("doc_id", "node")
    postings = rows.where("size(prefix) > 0").dropDuplicates(["node"]).select("node", F.col("n_shingles").cast("int").alias("n"), F.explode("prefix").alias("token"))
    heads = postings.groupBy("token").agg(F.count("*").alias("held"), F.min("node").alias("head")).where("held > 1")
    lists = scratch.keep(postings.join(heads, "token"), "lists")

    def enough(n: str, part: str = "{c}") -> str:
        """At least ``part`` of c, the merged lists that sets of n or more must share."""
        need = f"least(greatest({MERGED}, ceil({MERGED_PERCENT} * {n} / 100)), ceil({percent} * {n} / 100))"
        return f"shared >= {part.format(c=need)}"

    # groups: what shares enough lists with the class that leads them
    led = lists.where("node <> head").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.count("*").alias("shared"), F.min("n").alias("s"))
    stars = scratch.keep(led.where(enough("s")).select("a", "b"), "stars")
    first = scratch.keep(components(scratch, stars, "first").withColumnRenamed("root", "grp"), "groups")

    # lists where groups meet: if at most a quarter of c are lists where the one's group is a crowd, and at most a quarter
    # lists where the other's is, half of c are left where neither is
    named = lists.join(first, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    mixed = named.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    named = scratch.keep(named.join(mixed, "token").select("token", "node", "n", "grp"), "mixed")
    crowds = named.groupBy("token", "grp").agg(F.count("*").alias("held"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    crowds = scratch.keep(crowds, "crowds")
    of_size = F.expr(f"lo * {percent} <= n * 100 and hi * 100 >= n * {percent} and grp <> crowd")
    big = crowds.where(F.col("held") >= CROWD).select("token", F.col("grp").alias("crowd"), "lo", "hi")
    drawn = named.join(big, "token").where(of_size).groupBy("node", "crowd").agg(F.count("*").alias("shared"), F.min(F.least("n", "lo")).alias("s"))
    drawn = scratch.keep(drawn.where(enough("s", "floor({c} / 4) + 1")).select(F.col("node").alias("a"), F.col("crowd").alias("b")), "drawn")
    groups = first
    if scratch.figures["drawn"]["rows"]:
        groups = scratch.keep(components(scratch, stars.union(drawn), "group").withColumnRenamed("root", "grp"), "groups-2")

    few = crowds.where(F.col("held") < CROWD).select("token", "grp")
    few = scratch.keep(named.join(few, ["token", "grp"]), "few")
    blocks = few.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    few = few.join(blocks, "token")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = few.select("token", own.alias("i"), F.explode(every).alias("j"), F.col("node").alias("a"), F.col("n").alias("s"), F.col("grp").alias("ga"))
    right = few.select("token", F.explode(every).alias("i"), own.alias("j"), F.col("node").alias("b"), F.col("n").alias("t"), F.col("grp").alias("gb"))
    near = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (F.least("s", "t") * 100 >= F.greatest("s", "t") * percent)
    counted = left.join(right, ["token", "i", "j"]).where(near).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(F.least("s", "t")).alias("s"))
    pairs = counted.where(enough("s", "ceil({c} / 2)")).select("a", "b")
    for k in "ab":
        pairs = pairs.join(groups.select(F.col("node").alias(k), F.col("grp").alias(f"g{k}")), k, "left")
    pairs = scratch.keep(pairs.where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b"), "pairs")

    # inside groups, block by block
    blocks = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = scratch.keep(groups.join(blocks, "grp").select("node", "grp", own.alias("own"), "blocks"), "placed")
    met = _sets_of(scratch, docs, nodes, placed, shingle, "group-one").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "docs", "set")
    links = scratch.keep(met.groupBy("grp", "i", "j").applyInArrow(_search(percent, counts), "a long, b long, n long"), "links")

    # between groups, pair by pair
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = scratch.keep(_sets_of(scratch, docs, nodes, wanted, shingle, "pair-one"), "pair-sets")
    a, b = (sets.select(F.col("node").alias(k), F.col("set").alias(v), F.col("docs").alias(w)) for k, v, w in (("a", "p", "m"), ("b", "q", "n")))
    more = scratch.keep(pairs.join(b, "b").join(a, "a").select("a", "b", "p", "q", "m", "n").mapInArrow(_probe(percent), "a long, b long, m long, n long"), "more")
    root = components(scratch, links.where("a <> b").select("a", "b").union(more.select("a", "b")), "component")
    linked = links.where("a = b").select("a", "n").union(more.select("a", "n")).union(more.select("b", "m"))
    linked = linked.groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("others"))

    least = nodes.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    if counts:
        least = least.join(linked, F.col("node") == F.col("linked"), "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("others", F.lit(0))).drop("linked", "others")
    else:
        least = least.withColumn("n_links", F.lit(None).cast("long"))
    # written, so that the join with a large component's rows is dealt by itself and can be split
    least = scratch.keep(least.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "least")
    of_root = scratch.keep(least.groupBy("root").agg(F.min("least").alias("component_id")), "of-root")
    of_node = scratch.keep(least.join(scratch.small(of_root, "of-root"), "root").select("node", "root", "component_id", "n_links"), "result")
    scratch.clear("rows", "shared-keys", "result")
    out = rows.select("doc_id", "mark", "n_shingles", "node").join(of_node, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    n_links = F.coalesce("n_links", F.lit(0).cast("long")) if counts else F.col("n_links")
    return out.select("doc_id", "mark", "n_shingles", "node", "root", component.alias("component_id"), n_links.alias("n_links"))


def one_of_each(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without all but one of each component.

    The row with the least doc_id stays (null last; of equal ids with different texts, the text of the least hash;
    of equal rows, one). Documents without words are in no group: all of them stay.
    """
    scratch = Scratch(spark, "one-of-each")
    id_, mark = "__tallystone_id", "__tallystone_mark"
    found = join(spark, docs, shingle, percent, counts=False)
    rows = found.groupBy("root", "doc_id", "mark", (F.col("n_shingles") > 0).alias("some")).agg(F.count("*").alias("n"))
    first = rows.where("some").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark", "n")).alias("m"))
    stay = first.select(F.col("m.doc_id").alias(id_), F.col("m.mark").alias(mark), (F.col("m.n") > 1).alias("__tallystone_more"))
    stay = scratch.keep(stay.union(rows.where("not some").select("doc_id", "mark", F.lit(False)).distinct()), "stay")
    at = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"].cast("string")) == F.col(mark))
    kept = docs.join(scratch.small(stay, "stay"), at)
    once = kept.where("not __tallystone_more").select(docs.columns)
    return once.union(kept.where("__tallystone_more").dropDuplicates([id_, mark]).select(docs.columns))
